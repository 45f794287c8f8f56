"""Hash chains: sealing, parallel verification and replay of ordered tapes.

Sealing is a fold in order and is done once for each run; verification compares each record with its
stored neighbour only, so it needs no fold and runs in parallel within a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlode.functions.hashing import chain, ledger_identity
from fernlode.storage import map_batches


def seal(tape: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, seq, event_hash, chained_hash): h[n] = sha256(h[n-1] hex || event hash), h[-1] = ''.

    Rows of a run stream through one task in order; nothing of a run is held but the last hash.
    """
    dtype = tape.schema[run].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), ""
        for batch in batches:
            out = []
            for k, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    key, last = k, ""
                last = hashlib.sha256((last + digest).encode()).hexdigest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[run, "seq", "event_hash", "chained_hash"])

    rows = tape.select(run, F.col("seq").cast("long").alias("seq"), "event_hash")
    parts = int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(rows.repartition(parts, run).sortWithinPartitions(run, "seq"), fold, f"{run} {dtype}, seq long, event_hash string, chained_hash string")


def chain_roots(sealed: DataFrame, run: str = "run_id") -> DataFrame:
    return sealed.groupBy(run).agg(F.max_by("chained_hash", "seq").alias("root_hash"), F.count("*").alias("events"))


def verify_ledger(records: DataFrame, log: str = "log_id") -> DataFrame:
    """records(log, position, seq, kind_json, prev_hash, record_hash): per log ok, or the first failure and its place.

    A record fails as seq_gap (seq is not its position), prev_mismatch or hash_mismatch, in this order.
    """
    own = records.select(log, "position", "seq", "prev_hash", "record_hash", ledger_identity(F.col("seq"), F.col("kind_json")).alias("_id"))
    # The neighbour comes by an equality join on the place before, so that one long log is spread over all tasks.
    before = records.select(log, (F.col("position") + 1).alias("position"), F.col("record_hash").alias("_prev"))
    rows = own.join(before, [log, "position"], "left").withColumn("_prev", F.coalesce("_prev", F.lit("")))
    failure = F.when(F.col("seq") != F.col("position"), "seq_gap").when(F.col("prev_hash") != F.col("_prev"), "prev_mismatch").when(chain(F.col("_prev"), F.col("_id")) != F.col("record_hash"), "hash_mismatch")
    marked = rows.select(log, "position", "record_hash", failure.alias("failure"))
    # Sealed up to the first failure: only records before it have proven neighbours.
    return marked.groupBy(log).agg(
        F.count("*").alias("records"), F.min(F.when(F.col("failure").isNotNull(), F.struct("position", "failure"))).alias("_f"), F.max_by("record_hash", "position").alias("head_hash")
    ).select(log, "records", F.col("_f").isNull().alias("ok"), F.col("_f.failure").alias("failure"), F.col("_f.position").alias("failed_at"), "head_hash")


def replay_verify(tape: DataFrame, recorded: DataFrame, roots: DataFrame, run: str = "run_id") -> DataFrame:
    """Re-derive the chain of each run and compare: verified, and the first seq that diverges.

    recorded(run, seq, event_hash, chained_hash) is the stored spine, roots(run, root_hash) the stored roots.
    """
    derived = seal(tape, run)
    both = derived.join(recorded.select(run, "seq", F.col("event_hash").alias("_e"), F.col("chained_hash").alias("_c")), [run, "seq"], "full_outer")
    differs = ~(F.col("event_hash").eqNullSafe(F.col("_e")) & F.col("chained_hash").eqNullSafe(F.col("_c")))
    per = both.groupBy(run).agg(F.min(F.when(differs, F.col("seq"))).alias("_at"), F.min("seq").alias("_first"), F.max_by("chained_hash", "seq").alias("derived_root"))
    joined = per.join(roots, run, "left")
    ok = F.col("derived_root").eqNullSafe(F.col("root_hash")) & F.col("_at").isNull()
    return joined.select(run, ok.alias("verified"), F.when(~ok, F.coalesce("_at", "_first")).alias("diverged_at_seq"))


def replay_progress(tape: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each entry that a replay derives again: run, seq, chained_hash."""
    return seal(tape, run).select(run, "seq", "chained_hash")


#: The payload of each kind of event, in the order in which it is hashed.
EVENT_FIELDS = {
    "run_started": ("agent", "task", "cwd", "inputs"),
    "turn_started": ("turn",),
    "output": ("turn", "text"),
    "usage_updated": ("turn", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_micro_usd"),
    "turn_finished": ("turn", "ok"),
    "run_finished": ("ok", "exit_code", "timed_out"),
    "tool_started": ("turn", "tool", "title", "args_hash"),
    "tool_finished": ("turn", "tool", "ok", "title", "output_hash"),
}


def hash_events(tape: DataFrame, nested: bool = True) -> DataFrame:
    """event_hash of typed tape rows: SHA-256 of the compact JSON of seq and the kind's own fields, absent ones left out."""
    json = F.lit(None).cast("string")
    for kind, fields in EVENT_FIELDS.items():
        body = [F.lit(kind).alias("kind"), *(F.col(f) for f in fields if f in tape.columns)]
        parts = [F.col("seq").cast("long").alias("seq"), F.struct(*body).alias("kind")] if nested else [F.col("seq").cast("long").alias("seq"), *body]
        json = F.when(F.col("kind") == kind, F.to_json(F.struct(*parts))).otherwise(json)
    return tape.withColumn("event_hash", F.sha2(json, 256))


def label_identity() -> Column:
    """The hash of an outcome label (seq, outcome, source); the time of observation and derived hashes are zeroed before hashing."""
    json = F.to_json(F.struct(F.col("seq").cast("long").alias("seq"), F.struct("outcome").alias("outcome"), F.struct("source").alias("source"), F.lit(0).alias("observed_at_ms"), F.lit("").alias("label_hash"), F.lit("").alias("chained_hash")))
    return F.sha2(json, 256)


def seal_labels(labels: DataFrame) -> DataFrame:
    """Outcome labels as a chain for each run."""
    return seal(labels.withColumn("event_hash", label_identity()))
