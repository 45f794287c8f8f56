import random

import pytest

from fernlode.operators import index, search

CORPUS = "root_id string, rel_path string, text string"
WORDS = "license Apache term straße été 日本語 x under_score foo9 The in der ab".split()


def made(seed, n):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))
    rows = [(f"r{k % 2}", f"d{k % 3}/f{k}", "\n".join(line() for _ in range(rng.randrange(0, 7))) + rng.choice(["", "\n", "\r\n"])) for k in range(n)]
    return rows + [("r0", "empty", ""), ("r0", "nul", "license \0 binary"), ("r1", "late nul", "x" * 9000 + "\0 license"), ("r1", "ends", "ab"), ("r1", "nothing", None)]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(made(1, 80), CORPUS).repartition(3)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_any_literal_gives_the_rows_of_the_plain_search(corpus, monkeypatch):
    built = index.build_index(corpus)
    patterns = ["license", "icens", "ße é", "日本", "語", "t", "ab", "foo9 the", "under_", "absent here"]
    want = {p: rows_of(search.content_search(corpus.na.fill({"text": ""}), p, max_results=None)) for p in patterns}
    assert want["icens"] and want["日本"] and want["ab"] and not want["absent here"]
    for bound in (index.PLAN_CHUNKS, 0):
        monkeypatch.setattr(index, "PLAN_CHUNKS", bound)
        many = search.search_many(built, patterns, None).collect()
        got = {p: sorted((tuple(r)[1:] for r in many if r.pattern == p), key=str) for p in patterns}
        assert got == want


def test_updates_and_compaction(spark, corpus):
    built = index.build_index(corpus)
    added = spark.createDataFrame([("r0", "d0/f0", "new license text"), ("r2", "fresh", "relicensed\nlicense twice license"), ("r0", "empty", "now a term")], CORPUS)
    gone = spark.createDataFrame([("r1", "d1/f1"), ("r0", "d2/f2"), ("r9", "never there")], "root_id string, rel_path string")
    later = index.update_index(index.update_index(built, added, gone), None, spark.createDataFrame([("r1", "d0/f3")], "root_id string, rel_path string"))
    away = {(r.root_id, r.rel_path) for r in gone.collect()} | {("r1", "d0/f3")} | {(r.root_id, r.rel_path) for r in added.collect()}
    now = spark.createDataFrame([r for r in made(1, 80) if r[:2] not in away] + [tuple(r) for r in added.collect()], CORPUS).na.fill({"text": ""})
    small = index.compact(later)
    for pattern, cap in (("license", None), ("license", 5), ("the in", 4)):
        want = rows_of(search.content_search(now, pattern, max_results=cap))
        assert rows_of(search.content_search(None, pattern, max_results=cap, index=small)) == want
    assert (small.n, small.tokens) == (later.n, later.tokens)


def test_the_best_files_are_found_in_few_blocks(spark):
    rng = random.Random(6)
    rows = [("r", f"f{k:05}", " ".join(rng.choice(["filler", "other", "more"]) for _ in range(rng.randrange(1, 300))) + " license" * (rng.random() < 0.3) + " apache" * (rng.random() < 0.02)) for k in range(4000)]
    corpus = spark.createDataFrame(rows, CORPUS).repartition(4)
    built = index.build_index(corpus)
    for terms, k in ((["license"], 20), (["license", "apache"], 20), (["apache", "license", "none"], 5), (["none"], 5), (["other"], 1)):
        top = index.bm25_top(built, terms, k)
        every = search.bm25(corpus, terms).collect()
        want = sorted(((-r.score, r.rel_path, r.root_id) for r in every))[:k]
        assert sorted((-r.score, r.rel_path, r.root_id) for r in top.files.collect()) == want and top.found == len(want)
        assert not want or top.blocks_read * 3 < top.blocks or k == 1 and top.blocks_read < top.blocks


def test_grams():
    assert index.gram_ranges("abc") == index.gram_ranges("ABC") and len(index.gram_ranges("abcd")) == 2
    own = set(index.text_grams("Ab\ncde日本").tolist())
    holds = lambda p: any(any(lo <= g <= hi for g in own) for lo, hi in index.gram_ranges(p)) if len(p) < 3 else all(lo in own for lo, _ in index.gram_ranges(p))
    assert all(map(holds, ["a", "ab", "b", "cde", "e日", "de日本", "本"])) and not any(map(holds, ["bc", "日c", "x", "b\nc"]))


def test_fuzzy_scores():
    score = lambda path, pattern, case=False: int(search.fuzzy_scores([path], pattern, case)[0])
    assert score("src/FooBar.rs", "fb") > score("src/afobb.rs", "fb") > 0
    assert score("src/foo_bar.rs", "foo") > score("src/f_a_o_o.rs", "foo") > 0
    assert score("abc", "acb") == 0 and score("", "a") == 0 and score("Foo", "foo", True) == 0 and score("x" + "y" * 300 + "z", "xz") == 1
    assert search.fuzzy_scores([], "a", False).tolist() == []

    def best(path, pattern):
        """All placements of the pattern."""
        bonus = search._place_bonus(__import__("numpy").array([[ord(c) for c in path]]))[0].tolist()

        def go(i, last):
            if i == len(pattern):
                return 0
            options = []
            for j in range(last + 1, len(path)):
                if path[j].lower() == pattern[i]:
                    gap = j - last - 1
                    own = 16 + (2 * bonus[j] if i == 0 else max(bonus[j], 8) if gap == 0 else bonus[j] - 3 - (gap - 1))
                    rest = go(i + 1, j)
                    if rest is not None:
                        options.append(own + rest)
            return max(options, default=None)

        found = go(0, -1)
        return 0 if found is None else max(found, 1)

    rng = random.Random(2)
    for _ in range(300):
        path = "".join(rng.choice("abAB/_1.") for _ in range(rng.randrange(0, 12)))
        pattern = "".join(rng.choice("ab1") for _ in range(rng.randrange(1, 4)))
        assert score(path, pattern) == best(path, pattern), (path, pattern)


def test_terms_of_a_chunk_are_one_row(spark, corpus):
    """Written once for each chunk and read as blocks with the counts of the plain texts."""
    built = index.build_index(corpus)
    stored = spark.read.parquet(f"{built.segments[0]}/terms")
    assert stored.groupBy("term", "chunk").count().filter("count > 1").isEmpty()
    assert stored.count() < built.table("terms").count()
    dl, got = {(r.chunk, r.at): (r.rel_path, r.dl) for r in built.table("files").collect()}, {}
    for r in built.table("terms").collect():
        chunk = r.block // index.BLOCKS_A_CHUNK
        assert r.n == len(r.files) and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) and {chunk * index.BLOCKS_A_CHUNK + f // index.BLOCK_FILES for f in r.files} == {r.block}
        for at, tf, n in zip(r.files, r.tfs, r.dls):
            path, length = dl[chunk, at]
            assert n == length and (r.term, path) not in got
            got[r.term, path] = tf
    want = {}
    for _, path, text in made(1, 80):
        for word in [] if text is None or "\0" in text[:8192] else text.lower().replace("_", " ").split():
            word = word.replace("\0", " ").strip()
            want[word, path] = want.get((word, path), 0) + 1
    assert got == want


def test_scores_meet_numbers_and_not_texts(spark, corpus, monkeypatch):
    """The texts are joined once, by their numbers, with files that have their scores."""
    monkeypatch.setattr(index, "PLAN_CHUNKS", 0)
    monkeypatch.setattr(index, "BROADCAST_FILES", 0)
    found = index.matching_files(index.build_index(corpus), ["license", "the in"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and not found.isEmpty()
