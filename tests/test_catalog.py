import os

from pyspark.sql import functions as F

from fernlode.sources import catalog, logs


def tree(tmp_path):
    for rel in ("a/x.py", "a/deep/er/y.py", "a/deep/z.txt", "b/x.py", "b/skip/w.py", "top.py", "hot/1/2/3/4/v.py", "hot/1/2/u.py"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x" * (len(rel) * 10))
    (tmp_path / "a" / ".gitignore").write_text("*.txt\n!deep/z.txt\n")
    (tmp_path / "b" / ".gitignore").write_text("skip/\n")
    return str(tmp_path)


def test_units_cover_the_root_once(tmp_path):
    root = tree(tmp_path)
    whole = sorted(catalog.walk(root, "r"))
    for n in (1, 2, 3, 5, 20):
        units = catalog.frontier(root, catalog.Wanted(), n)
        parts = [catalog.walk(root, "r", [u]) for u in units]
        assert sorted(e for p in parts for e in p) == whole
    assert len(whole) == 9 and ("hot/1", True) in catalog.frontier(root, catalog.Wanted(), 4)


def test_pruned_folders_are_not_listed(tmp_path, monkeypatch):
    root, listed = tree(tmp_path), []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (listed.append(os.path.relpath(p, root)), scandir(p))[1])
    wanted = catalog.Wanted("a/deep/", ".py")
    rows = [r for u in catalog.frontier(root, wanted, 3) for r in catalog.walk(root, "r", [u], wanted)]
    assert [r[1] for r in rows] == ["a/deep/er/y.py"]
    assert set(listed) == {".", "a", "a/deep", "a/deep/er"}


def test_narrowed_scans(spark, tmp_path):
    root = tree(tmp_path)
    whole = [tuple(r) for r in catalog.scan(spark, {"r": root, "s": root}).collect()]
    assert len(whole) == 18
    for prefix, suffix, least, most in (("a/", "", 0, None), ("top.py", "", 0, None), ("", ".py", 0, 70), ("", "", 100, 160), ("hot/1/2", "v.py", 0, None), ("none", "", 0, None)):
        got = sorted(map(tuple, catalog.scan(spark, {"r": root, "s": root}, prefix, suffix, least, most).collect()))
        assert got == sorted(r for r in whole if r[1].startswith(prefix) and r[1].endswith(suffix) and r[3] >= least and (most is None or r[3] <= most))


def test_positions_follow_the_appends(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k string, n long"
    assert logs.read_ndjson(spark, path, schema, positions=True).count() == 0
    for k in ("c", "a", "b"):
        logs.append_ndjson(spark.range(3000).select(F.lit(k).alias("k"), F.col("id").alias("n")).repartitionByRange(5, "n").sortWithinPartitions("n"), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several tasks a file
    try:
        rows = logs.read_ndjson(spark, path, schema, positions=True)
        assert [(r.k, r.n) for r in rows.orderBy("position").collect()] == [(k, n) for k in "cab" for n in range(3000)]
        assert rows.select("position.file", "position.block").distinct().count() > 30
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "log.ndjson").write_text('{"k":"z","n":1}\nbroken\n{"k":"y","n":0}\n')
    assert [r.k for r in logs.read_ndjson(spark, str(tmp_path / "log.ndjson"), schema, positions=True).orderBy("position").collect()] == ["z", "y"]
