import numpy as np
import pytest

from fernlode.llm import embeddings
from fernlode.llm.embeddings import Codes, embedding_duplicates, plan_bands, rotation, upper_bounds


def data():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(10):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.02, 0.07, 0.11])).tolist(), c % 3))
    rows += [(500 + k, rows[5][1], rows[5][2]) for k in range(7)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, rows[5][1], None), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1), (608, [float("inf")] * 16, 1)]
    return rows


def brute(rows):
    ok = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    root, links = {i: i for i, _, _ in rows}, dict.fromkeys(label, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = ok[a], ok[b]
            if label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, links[i], find(i), find(i) == i) for i in label}


@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    frame = spark.createDataFrame(data(), "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert {tuple(r) for r in embedding_duplicates(frame).collect()} == brute(rows)


def test_empty(spark):
    assert embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, rep string")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + rng.standard_normal((200, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bands, bits = plan_bands(50_000)
    codes = Codes(x, rotation(64, -(-bands * bits // 64) * 64), bands, bits)
    rows = np.arange(400)
    true, upper = x @ x.T, upper_bounds(codes, rows, rows)
    error = (upper - codes.width[None, :] - true)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 2e-3 and (upper >= true).mean() > 0.999


def test_different_vectors_under_one_id(spark):
    rows = data()
    ids = {i: i % 50 if i < 600 else i for i, _, _ in rows}
    frame = spark.createDataFrame([(ids[i], v, l) for i, v, l in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    wide = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, l) for i, v, l in rows]
    found = brute(wide)
    least = {}
    for i, _, c, _ in found:
        least[c] = min(least.get(c, ids[i]), ids[i])
    expect = sorted((ids[i], n, least[c], ids[i] == least[c]) for i, n, c, _ in found)
    got = sorted(tuple(r) for r in embedding_duplicates(frame).collect())
    assert [g[:2] for g in got] == [e[:2] for e in expect]
    assert got == expect
