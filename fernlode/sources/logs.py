"""Evidence stores: NDJSON logs, JSON document folders, trace files, numstat and unified diffs; and their sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, materialize

SCHEMA_VERSION = 1
_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_ndjson(spark: SparkSession, path: str, schema: str, max_version: int = SCHEMA_VERSION, positions: bool = False) -> DataFrame:
    """Records of an appended log; malformed lines and records of a newer version are skipped.

    With ``positions`` each has a ``position`` that sorts them in the order in which they were appended.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, position {POSITION}" if positions else schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kept = F.coalesce("schema_version", F.lit(1)) <= max_version if "schema_version" in rows.columns else F.lit(True)
    if not positions:
        return rows.filter(kept)
    # A block of a file is read by one task from its start, so the numbers that a task gives rise within it.
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    files = materialize(_appended_files(spark, path), "log-files", narrow=True)
    joined = placed.join(broadcast_if_small(files, MAX_FILES), "_file")
    at = F.struct(F.col("_at").alias("appended_at"), F.col("_job").alias("job"), F.col("_part").alias("part"), F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row"))
    return joined.filter(kept).select(*rows.columns, at.alias("position"))


POSITION = "struct<appended_at: timestamp, job: string, part: int, file: string, block: bigint, row: bigint>"
MAX_FILES = 100_000


def _appended_files(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _job, _part, _at) of a log's files. Those that one append wrote have its id in their names and their order there; an append's time is that of its first file."""
    name = F.element_at(F.split("_file", "/"), -1)
    own = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"))
    pattern = "^part-([0-9]+)-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
    job = F.coalesce(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")), F.col("_file"))
    named = own.select("_file", "_time", job.alias("_job"), F.coalesce(F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("999999999")), F.lit(0)).cast("int").alias("_part"))
    return named.join(named.groupBy("_job").agg(F.min("_time").alias("_at")), "_job").drop("_time")


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON document of a folder; bad files are skipped; a missing folder is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """A worker tape (seq, node_id, payload); a malformed line fails the read."""
    return spark.read.schema("seq long, node_id string, payload string").option("mode", "FAILFAST").json(path)


def append_ndjson(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def append_with_heads(records: DataFrame, path: str, key: str, order: str) -> None:
    """Append records and rewrite the head document (the last record) of each key that they touch, below ``path-heads``."""
    append_ndjson(records, path)
    last = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), order).alias("_r"))
    write_documents(last.select("_r.*"), f"{path.rstrip('/')}-heads", key)


def write_documents(records: DataFrame, path: str, key: str) -> None:
    """One JSON document folder for each key; documents of other keys stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


_SPAN = "struct<start_unix_nano: bigint, span_id: string, gen_ai_operation: string, gen_ai_system: string, input_tokens: bigint, output_tokens: bigint, content_text: string>"


def parse_trace(text: str) -> list[tuple]:
    """Spans of a trace document, in either layout, attributes as a list or an object."""
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return []
    spans = list(doc.get("spans", []))
    for resource in doc.get("resourceSpans", []):
        for scope in resource.get("scopeSpans", resource.get("instrumentationLibrarySpans", [])):
            spans += scope.get("spans", [])

    def value(v):
        return next((v[k] for k in ("stringValue", "intValue", "doubleValue", "boolValue") if k in v), None) if isinstance(v, dict) else v

    def number(v):
        try:
            return int(float(v))
        except (TypeError, ValueError):
            return None

    out = []
    for s in spans:
        attributes = s.get("attributes", {})
        if isinstance(attributes, list):
            attributes = {a.get("key"): a.get("value") for a in attributes}
        a = {k: value(v) for k, v in attributes.items()}
        out.append((number(s.get("startTimeUnixNano", s.get("start_unix_nano"))) or 0, str(s.get("spanId", s.get("span_id", ""))), a.get("gen_ai.operation.name"), a.get("gen_ai.system"), number(a.get("gen_ai.usage.input_tokens")), number(a.get("gen_ai.usage.output_tokens")), a.get("gen_ai.completion", a.get("gen_ai.content"))))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trace_spans(traces: DataFrame, column: str = "body") -> DataFrame:
    """traces(trace_id, body) exploded to spans in (start, id) order."""
    parse = F.udf(parse_trace, f"array<{_SPAN}>")
    return traces.select("trace_id", F.posexplode(parse(F.col(column))).alias("position", "span")).select("trace_id", "position", "span.*")


def trace_to_tape(spans: DataFrame) -> DataFrame:
    """Tape of a trace: one run_started, output and usage_updated for each span, one run_finished; empty stays empty."""
    body = spans.select("trace_id", (F.col("position") * 2 + 1).cast("long").alias("seq"), F.explode(F.array(
        F.struct(F.lit(0).alias("d"), F.lit("output").alias("kind"), F.col("content_text").alias("text"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens")),
        F.struct(F.lit(1).alias("d"), F.lit("usage_updated").alias("kind"), F.lit(None).cast("string").alias("text"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens")))).alias("e"))
    rows = body.select("trace_id", (F.col("seq") + F.col("e.d")).alias("seq"), "e.kind", "e.text", "e.input_tokens", "e.output_tokens")
    ends = spans.groupBy("trace_id").agg(F.count("*").alias("n")).select("trace_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("run_started").alias("kind")), F.struct((F.col("n") * 2 + 1).alias("seq"), F.lit("run_finished").alias("kind")))).alias("e"))
    null = F.lit(None)
    return rows.unionByName(ends.select("trace_id", "e.seq", "e.kind", null.cast("string").alias("text"), null.cast("long").alias("input_tokens"), null.cast("long").alias("output_tokens")))


def parse_numstat(text: Column) -> Column:
    """array<struct<insertions, deletions, path>> of NUL-separated rows; '-' is null (binary)."""
    rows = F.filter(F.split(text, "\x00"), lambda r: r.contains("\t"))
    parts = F.transform(rows, lambda r: F.split(r, "\t", 3))
    number = lambda p, k: F.try_element_at(p, F.lit(k)).try_cast("long")
    return F.transform(parts, lambda p: F.struct(number(p, 1).alias("insertions"), number(p, 2).alias("deletions"), F.try_element_at(p, F.lit(3)).alias("path")))


def parse_diff(text: str) -> list[tuple[str, int]]:
    """(path, changed line) of the new side; a removed line marks the line that follows it. Hunk counts, not markers, say where a hunk ends."""
    out: list[tuple[str, int]] = []
    path, old, new, line = None, 0, 0, 0
    for row in (text or "").split("\n"):
        if old > 0 or new > 0:
            mark = row[:1]
            if mark == "+":
                out.append((path, line))
                line, new = line + 1, new - 1
            elif mark == "-":
                out.append((path, max(line, 1)))
                old -= 1
            elif mark != "\\":
                line, old, new = line + 1, old - 1, new - 1
            continue
        if row.startswith("+++ "):
            name = row[4:].split("\t")[0].strip('"')
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif (m := _HUNK.match(row)) and path is not None:
            old, line, new = int(m[1] or 1), int(m[2]), int(m[3] or 1)
    return list(dict.fromkeys(r for r in out if r[0]))


def changed_lines(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """diffs(diff_id, diff) as (diff_id, path, line)."""
    parse = F.udf(parse_diff, "array<struct<path:string,line:bigint>>")
    return diffs.select("diff_id", F.explode(parse(F.col(column))).alias("c")).select("diff_id", "c.path", "c.line")
