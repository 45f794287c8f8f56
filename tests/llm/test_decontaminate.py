import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fernlode.llm.decontaminate import contaminated, drop_contaminated, item_words, myers, pieces


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90))
def test_myers_is_the_semiglobal_distance(pattern, text):
    assert myers(pattern, text)[0] == distance_in(pattern, text)


def test_pieces_cover():
    for m in range(5, 90):
        p = pieces(m, m // 8)
        assert len(p) == m // 8 + 1 and sum(n for _, n in p) == m and all(n > 0 for _, n in p)


def test_against_brute_force(spark, docs_of, corpus):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(16, 50)))) for k in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, "a b c d e")]
    rows = [r for r in corpus if r[0] is not None]
    for k in range(40):
        words = items[k % 12][1].split()
        for _ in range(k % 6):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["odd"], [words[at], "new"]])
        rows.append((1000 + k, f"{rows[k % 20][1]}. {' '.join(words).upper()}! and more"))
    rows += [(2000, "x A, b; c D e y"), (2001, "a b c d"), (2002, "x; Two WORDS y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expect = set()
    words_of = {i: item_words(t).tolist() for i, t in items}
    for i, text in rows:
        w = item_words(text).tolist()
        for n, p in words_of.items():
            if len(p) and distance_in(p, w) <= len(p) // 8:
                expect.add((i, n, distance_in(p, w)))
    got = contaminated(docs_of(rows), bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == expect
    assert {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs_of(rows), bench, block_bytes=700).collect()} == expect
    assert {r.doc_id for r in drop_contaminated(docs_of(rows), bench).collect()} == {i for i, _ in rows} - {i for i, _, _ in expect}


def test_empty(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert contaminated(docs_of([]), bench).count() == 0
    assert contaminated(docs_of([(1, "one two three four five six"), (None, "one two three four five six")]), bench).count() == 2
    assert contaminated(docs_of([(1, "a b")]), bench.limit(0)).count() == 0


def test_short_items_and_places(spark, docs_of):
    item = " ".join(f"w{k}" for k in range(16))
    bench = spark.createDataFrame([(1, "what is two plus"), (2, item)], "item_id long, text string")
    more, less = item.replace("w8", "w8 new"), item.replace("w8 ", "")
    rows = [(1, "x what is two plus y"), (2, f"x {more} y"), (3, f"x {less} y"), (4, f"{item}"), (5, "what is two"), (6, "q " * 300_000 + item)]
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word, r.end_word) for r in contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1): (0, 1, 5), (2, 2): (1, 1, 18), (3, 2): (1, 1, 16), (4, 2): (0, 0, 16), (6, 2): (0, 300_000, 300_016)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.lists(st.integers(0, 3), max_size=40))
def test_anchored_myers_is_the_distance_from_the_start(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, t in enumerate(text, 1):
        new = [j]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != t), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, (row[-1], j))
    assert myers(pattern, text, anchored=True) == best
