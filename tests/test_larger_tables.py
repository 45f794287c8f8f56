"""Queries on tables with larger keys or other shapes than the given ones, against their twins."""

import random

import duckdb
import pandas as pd
import pytest

from fernlode.operators import blocks, graph
from fernlode.plans import registry
from fernlode.streaming import keyed

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder with the tables that are given as SQL over those of the smallest scale."""

    def make(**sql: str) -> str:
        for name, query in sql.items():
            duckdb.sql(f"COPY ({query.format(**{name: f"'{DIR}/{name}.parquet'"})}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def differences(spark, name: str, folder: str, *names: str) -> tuple[int, int, int]:
    """Rows of the query, and those that it has too many and too few."""
    con = duckdb.connect()
    for t in names:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, folder).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    con.register("got", got)
    con.register("want", want)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    return len(got), *(con.sql(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall()[0][0] for a, b in (("got", "want"), ("want", "got")))


def test_isolation_floor_of_long_ids(spark, tables):
    folder = tables(events="SELECT * REPLACE (user_id * (10 ** (event_id % 7))::BIGINT AS user_id) FROM {events}")
    rows, more, less = differences(spark, "isolation_floor", folder, "events")
    assert rows > 100 and (more, less) == (0, 0)


def test_pairs_by_tiles(spark, monkeypatch):
    """Many tiles and many runs in a tile; the pairs of the edges meet no exchange."""
    for name, value in {"TILE_PAIRS": 16, "TILE_ROWS": 40, "HELD_PAIRS": 8, "HELD_CELLS": 16}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(7)
    refs = [(f"f{rng.randrange(30)}", "go", "call", f"name{rng.randrange(25)}", k, 1) for k in range(400)]
    defs = sorted({(f"f{rng.randrange(40)}", f"name{rng.randrange(25)}") for _ in range(60)})
    uses = spark.createDataFrame(refs, "path string, language string, kind string, name string, line long, column long")
    symbols = spark.createDataFrame([(p, "go", "function", n, k, 1, k, k, "") for k, (p, n) in enumerate(defs)], "path string, language string, kind string, name string, line long, column long, start_line long, end_line long, signature string")
    want: dict[tuple[str, str], float] = {}
    for r in refs:
        for p, n in defs:
            if n == r[3] and p != r[0]:
                want[r[0], p] = want.get((r[0], p), 0) + 1
    edges = graph.reference_edges(uses, symbols)
    assert sorted((r.src, r.dst, r.weight) for r in edges.collect()) == sorted((*k, float(w)) for k, w in want.items())
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and "Join" not in plan.partition("RepartitionByExpression")[0]
    assert graph.reference_counters(uses, symbols).first().edge_count == len(want)


def test_ring_rows_come_in_pieces(monkeypatch):
    """Forty subscribers of a tape with a thousand frames."""
    monkeypatch.setattr(keyed, "RING_ROWS", 500)
    joins = [(k, -1, None, None, f"s{k}") for k in range(40)]
    frames = [(40 + k, k, None if k % 3 else "x", "p", None) for k in range(1000)]
    news = pd.DataFrame(joins + frames, columns=["at", "seq", "session", "payload", "subscriber"])
    parts = list(keyed._served(1, 20, [], {}, news, lambda v: None if pd.isna(v) else v))
    assert sum(len(p) for p in parts) == 40_000 and max(len(p) for p in parts) <= 540
    every = pd.concat(parts)
    assert every.groupby("subscriber").seq.nunique().eq(1000).all() and set(every.origin) == {"live"}


def test_walk_by_blocks(spark, monkeypatch):
    """Several blocks of nodes, several rows for two blocks, a node without edges."""
    monkeypatch.setattr(blocks, "BLOCK_NODES", 4)
    edges = [(f"n{a}", f"n{(a * a + k) % 21}", 0.5) for a in range(20) for k in (1, 2)]
    nodes = spark.createDataFrame([(f"n{k}", 1 / 21, k == 20) for k in range(21)], "key string, p double, dangling boolean")
    got = blocks.walk(nodes, [(spark.createDataFrame(edges, "src string, dst string, share double"), nodes)], 2, 0.85, 3)
    x = {f"n{k}": 1 / 21 for k in range(21)}
    for _ in range(2):
        x = {n: 0.15 / 21 + 0.85 * (x["n20"] / 21 + sum(x[a] * w for a, b, w in edges if b == n)) for n in x}
    assert {r.node: pytest.approx(r["rank"], abs=1e-12) for r in got.collect()} == x


def test_copies_of_tiles_do_not_grow_with_pairs():
    """Pairs grow with the square of the files; how often a side is copied must not, and a tile's defining side stays bounded."""
    for n in (1, 6, 36, 216):
        uses, defs = 10_000_000 * n, 400_000 * n
        i, j = blocks.tiles(758_000_000 * n * n, uses, defs, 12)
        assert i * j >= 12 and defs / j <= 4_000_000
        assert i * defs + j * uses <= (3 + defs / 4_000_000) * (uses + defs)


def test_edges_are_sent_in_large_batches():
    """Runs of a few files are added up at a time, and their edges leave together."""
    import pyarrow as pa

    rows = lambda n, **more: pa.RecordBatch.from_pydict({"path": [f"f{k}" for k in range(n)], "ids": [[k % 7, 7] for k in range(n)]} | {k: [v] * n for k, v in more.items()})
    got = list(blocks._sums(rows(1000, ws=[1.0, 2.0]), *blocks._by_id([rows(1000)]), False))
    assert sum(len(b) for b in got) == 1000 * 999 and min(len(b) for b in got[:-1]) >= 1 << 15 and max(len(b) for b in got) <= 1 << 16
    weights = {(s, d): w for b in got[:1] for s, d, w in zip(*(c.to_pylist() for c in b.columns))}
    assert weights["f0", "f7"] == 3 and weights["f0", "f1"] == 2 and ("f0", "f0") not in weights
    assert [b.column(0)[0].as_py() for b in blocks._sums(rows(1000, ws=[]), *blocks._by_id([rows(1000)]), True)] == [1000 * 999]


def test_ring_rows_leave_packed():
    """What leaves the state grows with the frames and subscribers that came, not with their product, and gives the same rows."""
    joins = [(k, -1, "x" if k % 2 else None, None, f"s{k}") for k in range(400)]
    frames = [(400 + k, k, ["x", "y", None][k % 3], "p", None) for k in range(3000)]
    late = [(3400, 2990, None, None, "late"), (3401, 3001, "y", "p", None)]
    news = pd.DataFrame(joins + frames + late, columns=["at", "seq", "session", "payload", "subscriber"])
    text = lambda v: None if pd.isna(v) else v
    packed = pd.concat(keyed._served(1, 20, [], {}, news, text, packed=True))
    assert len(packed) < 50 and packed["subscribers"].map(len).sum() + packed["seqs"].map(len).sum() < 5_000
    got = sorted((s, q, str(e), o) for names, seqs, sessions, o in zip(packed["subscribers"], packed["seqs"], packed["sessions"], packed["origin"]) for s in names for q, e in zip(seqs, sessions))
    plain = pd.concat(keyed._served(1, 20, [], {}, news, text))
    assert got == sorted(zip(plain["subscriber"], plain["seq"], plain["session"].map(str), plain["origin"])) and len(got) > 1_000_000


def test_uses_of_ranks_meet_in_one_shuffle(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(df, label, narrow=False, write=graph.materialize):
        if label == "uses":
            raise Stop(df)
        return write(df, label, narrow)

    monkeypatch.setattr(graph, "materialize", stop)
    refs = spark.createDataFrame([("a", "go", "foo"), ("a", "go", "foo"), ("a", "go", "baz"), ("b", "go", "foo"), ("b", "go", "none")], "path string, language string, name string")
    symbols = spark.createDataFrame([("a", "go", "foo"), ("b", "go", "foo"), ("c", "go", "baz")], "path string, language string, name string")
    with pytest.raises(Stop) as held:
        graph.reference_ranks(refs, symbols, spark.createDataFrame([("a",), ("b",), ("c",)], "node string"))
    uses = held.value.args[0]
    assert sorted((r.path, r.name, r.w, r.files, r.own, r.total) for r in uses.collect()) == [("a", "go\0baz", 1, 1, 0, 3), ("a", "go\0foo", 2, 2, 1, 3), ("b", "go\0foo", 1, 2, 1, 1)]
    assert uses._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
