"""Scalar functions, digests, merges and streams over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.functions import hashing, text
from fernlode.operators import chains, codemap, context, evidence
from fernlode.plans.evidence_queries import _CHECKS, _LABELS, checks, labels
from fernlode.plans.search_queries import documents
from fernlode.sources import logs
from fernlode.storage import _cores, new_path
from fernlode.streaming import keyed, tapes

RING_PARTS_A_CORE = 8


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _verdict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = checks(spark, sf_dir).select("verdict_id", "seq", hashing.sha256_json(F.struct("name", "kind", "status")).alias("h"))
    rows = own.groupBy("verdict_id").agg(F.array_sort(F.collect_list(F.struct("seq", "h"))).alias("c"))
    none = F.lit(None).cast("string")
    return rows.select(F.col("verdict_id").alias("run_id"), hashing.verdict_id(F.col("verdict_id"), none, F.lit("spec"), none, F.transform("c", lambda x: x["h"])).alias("verdict_id"))


def _ledger_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence records: a run, then its verdict, then a receipt for two verdicts in three."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("k"))
    kind = F.element_at(F.array(F.lit("run_recorded"), F.lit("verdict"), F.lit("receipt_issued")), (F.col("k") % 3 + 1).cast("int"))
    g = F.floor(F.col("k") / 3)
    return e.select(kind.alias("kind"), F.concat(F.lit("run"), g).alias("run_id"), F.sha2(g.cast("string"), 256).alias("run_root_hash"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("v"), F.when(F.col("k") % 3 == 2, g - g % 3 + F.when(g % 3 == 2, -1).otherwise(g % 3)).otherwise(g))).alias("verdict_id"), F.concat(F.lit("r"), g).alias("receipt_id"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    span = F.struct(F.col("event_id").cast("string").alias("spanId"), F.col("event_id").alias("startTimeUnixNano"), F.create_map(F.lit("gen_ai.usage.input_tokens"), (F.col("event_id") % 50).cast("string"), F.lit("gen_ai.completion"), F.col("event_type")).alias("attributes"))
    rows = e.groupBy(F.col("user_id").alias("trace_id")).agg(F.collect_list(span).alias("spans"))
    return rows.select("trace_id", F.to_json(F.struct("spans")).alias("body"))


def _stream(spark: SparkSession, sf_dir: str, transform, files: int = 3) -> DataFrame:
    """A streaming query over ``events`` run to its end: a source of several files, one a trigger, a stateful operator, a Parquet sink."""
    events = _events(spark, sf_dir)
    path, last = new_path(spark, "stream-in"), events.agg(F.max("event_id")).first()[0] or 0
    for k in range(files):  # in the order of the events, so that state goes from trigger to trigger
        events.filter(F.floor(F.col("event_id") * files / (last + 1)) == k).coalesce(1).write.mode("append").parquet(path)
    rows = transform(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _redelivered(spark: SparkSession, rows: DataFrame, at: str, transform, files: int = 3) -> DataFrame:
    """A stateful query over ``rows`` in the order of ``at``, a file a trigger, each file but the first with the rows of the one before once more."""
    path, last, own = new_path(spark, "stream-in"), rows.agg(F.max(at)).first()[0] or 0, keyed.state_session(spark)
    part = F.floor(F.col(at) * files / (last + 1))
    for k in range(files):
        rows.filter(part.between(max(k - 1, 0), k)).coalesce(1).write.mode("append").parquet(path)
    out = transform(own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    target, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


def _stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a ledger, appended in triggers that overlap, then verified."""
    e = _events(spark, sf_dir)
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    rows = e.select("event_id", F.col("user_id").alias("log_id"), place.alias("seq"), F.to_json(F.struct("event_type")).alias("kind_json"))
    out = _redelivered(spark, rows, "event_id", keyed.append_ledger)
    return chains.verify_ledger(out.withColumn("position", F.col("seq"))).select("log_id", "records", "ok", "head_hash")


def _stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _redelivered(spark, labels(spark, sf_dir), "seq", keyed.append_labels)
    return chains.chain_roots(out)


def _stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames on 16 tapes with rings of 20; one event in 499 is a subscriber of its tape, from 400 events back, every other one of a session."""
    e = _events(spark, sf_dir)
    rows = e.select("event_id", (F.col("user_id") % 16).alias("tape"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("session"), F.col("event_type").alias("payload"))
    rows = rows.select("*", (F.col("event_id") % 499 == 7).alias("joins"))

    def transform(s: DataFrame) -> DataFrame:
        frames = s.filter("NOT joins").select("tape", F.col("event_id").alias("at"), F.col("event_id").alias("seq"), "session", "payload")
        new = s.filter("joins").select("tape", F.col("event_id").alias("at"), F.col("event_id").cast("string").alias("subscriber"), (F.col("event_id") - 400).alias("after"), F.when(F.col("event_id") % 2 == 0, F.lit("click")).alias("session"))
        return keyed.replay_ring_packed(frames, new, 20)

    path, last, own = new_path(spark, "stream-in"), rows.agg(F.max("event_id")).first()[0] or 0, keyed.state_session(spark)
    for k in range(3):
        rows.filter(F.floor(F.col("event_id") * 3 / (last + 1)) == k).coalesce(1).write.mode("append").parquet(path)
    out = transform(own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    target, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # Packed rows are few and unequal: dealt out before they become the rows of all subscribers.
    return keyed.ring_rows(spark.read.schema(out.schema).parquet(target).repartition(RING_PARTS_A_CORE * (_cores(spark) or spark.sparkContext.defaultParallelism)))


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0), "run_finished").otherwise(F.col("event_type"))
    return _stream(spark, sf_dir, lambda s: tapes.capture(s.select(F.col("user_id").alias("run_id"), "event_id", kind.alias("kind"))))


def _brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("long"))
    return _stream(spark, sf_dir, lambda s: tapes.budget_brake(s.select(F.col("user_id").alias("run_id"), "event_id", cost.alias("cost")), 50_000))


QUERIES = {
    "token_counts": lambda s, d: documents(s, d).select("root_id", "rel_path", text.count_tokens(F.col("text")).alias("tokens")),
    "tokenize_text": lambda s, d: documents(s, d).select("rel_path", F.explode(text.tokenize_text(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("rel_path").alias("files")),
    "line_counts": lambda s, d: documents(s, d).select("rel_path", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines")),
    "field_terms": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(text.field_terms_column(F.concat_ws("_", "p_name", "p_brand"))).alias("term")),
    "epoch_text": lambda s, d: _events(s, d).select("event_id", text.epoch_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at")),
    "usd_to_micro": lambda s, d: _events(s, d).select("event_id", text.usd_to_micro(F.col("value") - 5).alias("micro")),
    "verdict_ids": _verdict_ids,
    "seal_labels": lambda s, d: chains.chain_roots(chains.seal_labels(labels(s, d))),
    "run_lineage": lambda s, d: evidence.run_lineage(_ledger_kinds(s, d)),
    "merge_live": lambda s, d: evidence.merge_live(_events(s, d).filter("event_type <> 'view'").select(F.col("event_id").alias("id"), F.lit("live").alias("origin")), _events(s, d).filter("event_type <> 'purchase'").select(F.col("event_id").alias("id"), F.lit("stored").alias("origin"))),
    "churn": lambda s, d: evidence.churn(_events(s, d).select(F.concat(F.lit("f"), F.col("user_id")).alias("path"), F.when(F.col("event_type") != "view", F.col("event_id") % 7).alias("insertions"), F.when(F.col("event_type") != "view", F.col("event_id") % 5).alias("deletions"))),
    "numstat": lambda s, d: _events(s, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.when(F.col("event_type") == "view", "-").otherwise((F.col("event_id") % 9).cast("string")), F.lit("1"), F.concat(F.lit("p"), F.col("event_id"))))), "\x00").alias("t")).select("user_id", F.inline(logs.parse_numstat(F.col("t")))),
    "trace_to_tape": lambda s, d: logs.trace_to_tape(logs.trace_spans(_traces(s, d))),
    "replay_window": lambda s, d: tapes.replay(_events(s, d).select(F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("session")), 9_100, "click", 1024),
    "stream_capture": _capture,
    "stream_budget_brake": _brake,
    "stream_ledger": _stream_ledger,
    "stream_labels": _stream_labels,
    "stream_ring": _stream_ring,
    "windowed_counts": lambda s, d: tapes.windowed_counts(_events(s, d)),
    "select_remove": lambda s, d: context.select_ops(documents(s, d).select("root_id", F.col("rel_path").alias("path"), F.lit("full").alias("mode"), F.lit(1).alias("seq")), documents(s, d).filter("language = 'en'").select("root_id", F.col("rel_path").alias("path")), "remove").select("root_id", "path"),
    "code_map": lambda s, d: codemap.code_structure(codemap.parse_corpus(documents(s, d).withColumn("rel_path", F.concat("rel_path", F.lit(".py"))).withColumn("text", F.regexp_replace("text", "(?m)^([A-Za-z]+)", "def $1(x):")))).select("path", "n_symbols", "tokens"),
}

ORACLE_SQL = {
    "token_counts": "SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM documents",
    "tokenize_text": "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS files FROM t GROUP BY 1",
    "line_counts": "SELECT CAST(doc_id AS VARCHAR) AS rel_path, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) END AS BIGINT) AS n_lines FROM documents",
    "field_terms": "SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), ['brand', regexp_extract(p_brand, '[0-9]+')])) AS term FROM part",
    "epoch_text": "SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "usd_to_micro": "SELECT event_id, CASE WHEN value - 5 >= 0 THEN CAST(round((value - 5) * 1000000) AS BIGINT) END AS micro FROM events",
    "verdict_ids": f"""WITH {_CHECKS}, h AS (SELECT verdict_id, seq, sha256('{{"name":"' || name || '","kind":"' || kind || '","status":"' || status || '"}}') AS h FROM k)
        SELECT verdict_id AS run_id, sha256(verdict_id || chr(10) || '' || chr(10) || 'spec' || chr(10) || '' || chr(10) || string_agg(h, chr(10) ORDER BY seq)) AS verdict_id FROM h GROUP BY verdict_id""",
    "seal_labels": f"""WITH RECURSIVE {_LABELS}, n AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k, sha256('{{"seq":' || seq || ',"outcome":{{"outcome":"' || outcome || '"}},"source":{{"source":"ci"}},"observed_at_ms":0,"label_hash":"","chained_hash":""}}') AS e FROM l),
        h AS (SELECT run_id, k, sha256(e) AS c FROM n WHERE k = 1 UNION ALL SELECT n.run_id, n.k, sha256(h.c || n.e) FROM h JOIN n ON n.run_id = h.run_id AND n.k = h.k + 1) SELECT run_id, arg_max(c, k) AS root_hash, count(*) AS events FROM h GROUP BY 1""",
    "run_lineage": """WITH e AS (SELECT event_id AS k, event_id // 3 AS g FROM events), r AS (SELECT g FROM e WHERE k % 3 = 0), v AS (SELECT g FROM e WHERE k % 3 = 1), q AS (SELECT g - g % 3 + CASE WHEN g % 3 = 2 THEN -1 ELSE g % 3 END AS vg, g FROM e WHERE k % 3 = 2)
        SELECT 'run' || v.g AS run_id, 'v' || v.g AS verdict_id, 'r' || q.g AS receipt_id FROM v JOIN r USING (g) LEFT JOIN q ON q.vg = v.g""",
    "merge_live": "SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN 'live' ELSE 'stored' END AS origin FROM events",
    "churn": "SELECT 'f' || user_id AS path, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 7 + event_id % 5 END) AS BIGINT) AS churn FROM events GROUP BY user_id",
    "numstat": "SELECT user_id, CASE WHEN event_type <> 'view' THEN event_id % 9 END AS insertions, CAST(1 AS BIGINT) AS deletions, 'p' || event_id AS path FROM events",
    "trace_to_tape": """WITH s AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, event_type, event_id % 50 AS i FROM events)
        SELECT trace_id, p * 2 + 1 AS seq, 'output' AS kind, event_type AS text, CAST(NULL AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM s UNION ALL SELECT trace_id, p * 2 + 2, 'usage_updated', NULL, i, 0 FROM s
        UNION ALL SELECT trace_id, 0, 'run_started', NULL, NULL, NULL FROM s GROUP BY 1 UNION ALL SELECT trace_id, 2 * count(*) + 1, 'run_finished', NULL, NULL, NULL FROM s GROUP BY 1""",
    "replay_window": "SELECT event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS session FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1024 AND event_id > 9100 AND event_type IN ('view', 'click')",
    "stream_capture": """WITH e AS (SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'run_finished' ELSE event_type END AS kind FROM events), f AS (SELECT run_id, min(event_id) AS last FROM e WHERE kind = 'run_finished' GROUP BY 1)
        SELECT e.run_id, row_number() OVER (PARTITION BY e.run_id ORDER BY event_id) - 1 AS seq, event_id, kind FROM e LEFT JOIN f USING (run_id) WHERE last IS NULL OR event_id <= last""",
    "stream_budget_brake": """WITH u AS (SELECT user_id AS run_id, event_id, CAST(sum(CASE WHEN event_type = 'view' THEN 50000 ELSE CAST(round(value * 100) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS spent FROM events) SELECT *, spent > 50000 AS exhausted FROM u""",
    "windowed_counts": "SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "select_remove": "SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS path FROM documents WHERE lang <> 'en'",
}

ORACLE_SQL["stream_labels"] = ORACLE_SQL["seal_labels"]
ORACLE_SQL["stream_ledger"] = """WITH RECURSIVE n AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, '{"event_type":"' || event_type || '"}' AS j FROM events),
    e AS (SELECT log_id, seq, sha256(from_hex(printf('%02x%02x%02x0000000000', seq % 256, seq // 256 % 256, seq // 65536)) || encode(j)) AS e FROM n),
    h AS (SELECT log_id, seq, sha256(e) AS c FROM e WHERE seq = 0 UNION ALL SELECT e.log_id, e.seq, sha256(h.c || e.e) FROM h JOIN e ON e.log_id = h.log_id AND e.seq = h.seq + 1)
    SELECT log_id, count(*) AS records, true AS ok, arg_max(c, seq) AS head_hash FROM h GROUP BY 1"""
ORACLE_SQL["stream_ring"] = """WITH f AS (SELECT user_id % 16 AS tape, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS session, event_type AS payload, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS r FROM events WHERE event_id % 499 <> 7),
    s AS (SELECT user_id % 16 AS tape, event_id AS at, CASE WHEN event_id % 2 = 0 THEN 'click' END AS own FROM events WHERE event_id % 499 = 7),
    c AS (SELECT s.*, (SELECT count(*) FROM f WHERE f.tape = s.tape AND f.seq < s.at) AS n FROM s)
    SELECT f.tape, CAST(c.at AS VARCHAR) AS subscriber, f.seq, f.session, f.payload, CASE WHEN f.seq < c.at THEN 'replay' ELSE 'live' END AS origin FROM c JOIN f USING (tape)
    WHERE (f.seq > c.at OR f.r > c.n - 20 AND f.seq > c.at - 400) AND (own IS NULL OR f.session IS NULL OR f.session = own)"""
