import pandas as pd
from pyspark.sql import functions as F

from fernlode.operators import chains
from fernlode.streaming import keyed


def run(spark, tmp_path, schema, deliveries, transform):
    """Each delivery is a file and a run of the query of its own, from the checkpoint of the one before."""
    own, out = keyed.state_session(spark), str(tmp_path / "out")
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frame = transform(own.readStream.schema(schema).parquet(str(tmp_path / "in")))
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def test_ledger_over_restarts(spark, tmp_path):
    record = lambda log, *seqs: [(log, s, f'{{"n":{s}}}') for s in seqs]
    deliveries = [
        record("a", 1, 0) + record("b", 2) + [(None, 0, "{}"), ("c", None, "{}")],
        record("a", 0, 1, 2, 2) + record("b", 1),  # delivered again, repeated within a batch, still early
        record("a", 5) + record("b", 0, 1),
    ]
    out = run(spark, tmp_path, "log_id string, seq long, kind_json string", deliveries, keyed.append_ledger)
    assert sorted((r.log_id, r.seq) for r in out.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert {(r.log_id, r.records, r.ok) for r in chains.verify_ledger(out.withColumn("position", F.col("seq"))).collect()} == {("a", 3, True), ("b", 3, True)}


def test_labels_are_sealed_like_a_table(spark, tmp_path):
    schema = "run_id long, seq long, outcome string, source string"
    first, more = [(1, 3, "merged", "ci"), (1, 9, None, "ci"), (2, 4, "reverted", None)], [(1, 12, "incident", "ci"), (3, 0, "merged", "x")]
    out = run(spark, tmp_path, schema, [first, first + more], keyed.append_labels)
    whole = chains.seal_labels(spark.createDataFrame(first + more, schema)).select("run_id", "seq", "chained_hash")
    assert sorted(map(tuple, out.select("run_id", "seq", "chained_hash").collect())) == sorted(map(tuple, whole.collect()))


def test_ring_evicts_and_fans_out(spark, tmp_path):
    schema = "tape string, at long, session string, payload string, subscriber string, after long"
    frame = lambda at, session=None: ("t", at, session, f"p{at}", None, None)
    joins = lambda at, who, after, session=None: ("t", at, session, None, who, after)

    def transform(s):
        frames = s.filter("subscriber IS NULL").select("tape", "at", F.col("at").alias("seq"), "session", "payload")
        return keyed.replay_ring(frames, s.filter("subscriber IS NOT NULL").select("tape", "at", "subscriber", "after", "session"), 3)

    deliveries = [
        [frame(k) for k in range(8)] + [joins(10, "x", 4)],
        [frame(11, "s"), frame(12, "o"), joins(13, "y", None, "s"), frame(14, "o"), frame(15, "s")],
        [joins(16, "x", 12), frame(17)],
    ]
    out = run(spark, tmp_path, schema, deliveries, transform)
    got = sorted((r.subscriber, r.seq, r.origin) for r in out.collect())
    assert got == sorted(
        [("x", k, "replay") for k in (5, 6, 7)] + [("x", k, "live") for k in (11, 12, 14, 15)] + [("y", 7, "replay"), ("y", 11, "replay"), ("y", 15, "live")]
        + [("x", k, "replay") for k in (14, 15)] + [("x", 17, "live"), ("y", 17, "live")]
    )


def test_a_chain_asks_its_state_no_more_than_it_must():
    """Every call of a state is a message: two reads and a write for a log without early records."""
    calls = []

    class State:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def __getattr__(self, call):
            def run(*args):
                calls.append((self.name, call))
                self.value = args[0] if call in ("update", "put") else [] if call == "clear" else self.value
                return self.value

            return run

    chain = keyed._Chain(True)
    chain.head, chain.early = State("head", None), State("early", [])
    rows = lambda *seqs: iter([pd.DataFrame({"seq": seqs, "payload": [f"p{s}" for s in seqs], "event_hash": [f"d{s}" for s in seqs]})])
    first = pd.concat(chain.handleInputRows(("a",), rows(1, 0), None))
    assert first["seq"].tolist() == [0, 1] and list(first.columns) == keyed.CHAIN_COLUMNS
    assert calls == [("head", "get"), ("early", "get"), ("head", "update")]
    assert len(pd.concat(chain.handleInputRows(("a",), rows(3, 1), None))) == 0 and [e[0] for e in chain.early.value] == [3]
    later = pd.concat(chain.handleInputRows(("a",), rows(2), None))
    assert later["seq"].tolist() == [2, 3] and later["payload"].tolist() == ["p2", "p3"] and calls[-1] == ("early", "clear")
