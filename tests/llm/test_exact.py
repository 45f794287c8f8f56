import hashlib
import random

from fernlode.llm import exact
from fernlode.llm.exact import drop_exact_duplicates, exact_duplicates, repeated_bits, text_digests


def fold(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[fold(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(fold(t)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs_of, corpus):
    rows = corpus + [(500, "Straße É"), (501, "sTRASSE É"), (502, "sTRAßE É"), (503, "straße é"), (None, None), (504, "X" * 5000), (3, "other text")]
    got = exact_duplicates(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_ids_that_are_all_null(docs_of):
    rows = [(None, "a"), (None, "A"), (None, "b")]
    assert sorted((tuple(r) for r in exact_duplicates(docs_of(rows)).collect()), key=str) == brute(rows)


def test_a_hot_text_and_a_small_filter(docs_of):
    """A full filter lets more rows through, and the answer stays."""
    rng = random.Random(4)
    rows = [(i, "hot TEXT" if i % 3 == 0 else f"text {rng.randrange(1500)}") for i in range(3000)]
    for size in (exact.MAX_FILTER_BYTES, 1):
        assert sorted((tuple(r) for r in exact_duplicates(docs_of(rows), size).collect()), key=str) == brute(rows)


def test_most_single_rows_pass_straight_through(docs_of, monkeypatch):
    monkeypatch.setattr(exact, "FLUSH_ROWS", 50)
    rows = [(i, f"text {i // 2 if i < 200 else i}") for i in range(4000)]
    digests = text_digests(docs_of(rows))
    bits = repeated_bits(digests, exact.filter_blocks(4000))
    tested = digests.withColumn("block", (digests["block"] % exact.filter_blocks(4000)).cast("int")).join(bits, "block", "left").select("doc_id", exact._may_repeat().alias("c"))
    hits = {r.doc_id for r in tested.collect() if r.c}
    assert set(range(200)) <= hits and len(hits) < 300


def test_without_broadcast_and_empty(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_GROUPS", 0)
    assert sorted((tuple(r) for r in exact_duplicates(docs_of(corpus)).collect()), key=str) == brute(corpus)
    assert exact_duplicates(docs_of([])).count() == 0 and drop_exact_duplicates(docs_of([])).count() == 0


def test_drop_keeps_one_row_and_all_columns(spark, docs_of, corpus):
    rows = corpus + [(3, "other text"), (600, "Same"), (600, "same"), (None, "only null"), (None, "ONLY null")]
    docs = docs_of(rows).withColumnRenamed("length", "a.b").withColumnRenamed("component", "_digest")
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, fold(r.text)) for r in kept.collect()), key=str)
    want = {}
    for i, t in rows:
        want.setdefault(fold(t), []).append(i)
    assert got == sorted(((max((x for x in own if x is not None), default=None), t) for t, own in want.items()), key=str)


def test_very_long_texts(docs_of):
    long = "Word " * 400_000
    rows = [(1, long), (2, long.upper()), (3, long + "x")]
    assert sorted((tuple(r) for r in exact_duplicates(docs_of(rows)).collect()), key=str) == brute(rows)
