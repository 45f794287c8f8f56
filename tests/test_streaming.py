import pandas as pd
from pyspark.sql import functions as F

from fernlode.plans.search_queries import documents  # noqa: F401  (imports the registry's parts)
from fernlode.streaming import tapes

EVENTS = "/root/testdata/sf0.001/events.parquet"
SCHEMA = "event_id long, run_id long, kind string, cost long"


def files(spark, tmp_path):
    e = spark.read.parquet(EVENTS).select("event_id", F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 97 == 5, "run_finished").otherwise("output").alias("kind"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 50).alias("cost"))
    for k in range(3):
        e.filter(F.floor(F.col("event_id") * 3 / 1000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e


def drain(frame, spark, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_capture_equals_batch(spark, tmp_path):
    rows = [(r.run_id, r.event_id, r.kind) for r in files(spark, tmp_path).orderBy("event_id").collect() if r.event_id < 1000]
    expect, count, sealed = set(), {}, set()
    for run, event, kind in rows:
        if run not in sealed:
            expect.add((run, count.setdefault(run, 0), event, kind))
            count[run] += 1
            if kind == "run_finished":
                sealed.add(run)
    got = drain(tapes.capture(tapes.read_stream(spark, str(tmp_path / "in"), SCHEMA)), spark, "captured")
    assert {tuple(r) for r in got} == expect


def test_budget_brake(spark, tmp_path):
    rows = [(r.run_id, r.event_id, r.cost) for r in files(spark, tmp_path).orderBy("event_id").collect() if r.event_id < 1000]
    spent, expect = {}, set()
    for run, event, cost in rows:
        spent[run] = spent.get(run, 0) + (300 if cost is None else cost)
        expect.add((run, event, spent[run], spent[run] > 300))
    got = drain(tapes.budget_brake(tapes.read_stream(spark, str(tmp_path / "in"), SCHEMA), 300), spark, "braked")
    assert {tuple(r) for r in got} == expect


def test_ledger_sink(spark, tmp_path):
    batch = spark.createDataFrame([("a", 0, "{}"), ("a", 1, "{}"), ("b", 0, "{}")], "log_id string, seq long, kind_json string")
    tapes.append_ledger(batch, str(tmp_path / "ledger"), 0)
    more = spark.createDataFrame([("a", 2, "{}")], batch.schema)
    for _ in range(2):  # delivered twice
        tapes.append_ledger(more, str(tmp_path / "ledger"), 1)
    for k in range(2, 5):
        tapes.append_ledger(spark.createDataFrame([("a", k + 1, "{}"), ("c", k - 2, "{}")], batch.schema), str(tmp_path / "ledger"), k)
    from fernlode.operators.chains import verify_ledger

    assert sorted(p.name for p in (tmp_path / "ledger-heads").glob("batch=*")) == ["batch=3", "batch=4"]
    rows = spark.read.parquet(str(tmp_path / "ledger")).withColumn("position", F.col("seq"))
    assert {(r.log_id, r.records, r.ok) for r in verify_ledger(rows).collect()} == {("a", 6, True), ("b", 1, True), ("c", 3, True)}


def test_replay(spark):
    frames = spark.createDataFrame([(k, None if k % 3 == 0 else f"s{k % 3}") for k in range(100)], "seq long, session string")
    assert [r.seq for r in tapes.replay(frames, 90, "s1", 20).orderBy("seq").collect()] == [91, 93, 94, 96, 97, 99]
    assert tapes.replay(frames, 10, None, 20).count() == 20


def test_windows(spark):
    e = spark.read.parquet(EVENTS)
    assert tapes.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_rows_of_a_run_are_ordered_as_columns():
    frames = [pd.DataFrame({"event_id": [7, 3], "cost": [2**60 + 1, 5]}), pd.DataFrame({"event_id": [4], "cost": [6]})]
    event, cost = tapes._in_order(iter(frames), "cost")
    assert event.tolist() == [3, 4, 7] and cost.tolist() == [5, 6, 2**60 + 1]
