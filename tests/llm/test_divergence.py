import random
import re
from collections import Counter

import pytest

from fernlode.llm import divergence
from fernlode.llm.divergence import source_audit

DDL = "doc_id long, text string, lang string, source string, term string, n int, p int, value long, item string"


def brute(rows, minimum, top):
    groups, found, langs = {}, {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault((lang, source), Counter()).update(terms)
        found.setdefault(lang, Counter()).update(set(terms))
        langs.setdefault(lang, Counter()).update(terms)
    out = []
    for (lang, source), own in groups.items():
        kept = {t for t, d in found[lang].items() if d >= minimum}
        v = len(kept)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        mine, whole = p(own), p(langs[lang])
        pairs = [(sum(abs(mine[t] - q) for t, q in p(other).items()), s) for (ln, s), other in groups.items() if ln == lang and s != source]
        terms = [(mine[t] - whole[t], t) for t in kept if own[t] and mine[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.fixture
def made():
    """Languages and sources of very different sizes, terms of very different frequency, odd texts."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "alpha beta Gamma délta straße 日本 ωmega Łódź".split() for b in "one TWO three x".split()]
    rows = []
    for k in range(260):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["a", "a", "a", "b", "c", f"s{k % 5}", None, "é"])
        pool = words[: 8 + 3 * (ord(source[0]) % 9 if source else 4)]
        rows.append((k, " ".join(rng.choice(pool) if rng.random() < 0.9 else f"{rng.choice(pool)},x2y" for _ in range(rng.randrange(0, 60))), lang, source))
    return rows + [(900, None, "en", "a"), (901, "", "xx", "only"), (902, "12 34 _-", "xx", "other"), (903, "word " * 30_000, "en", "long"), (1, "one more", "en", "b"), (1, "one more", "en", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], DDL).repartition(3)


@pytest.mark.parametrize(("minimum", "top"), [(1, 3), (10, 50), (30, 2)])
def test_against_brute_force(spark, made, minimum, top):
    got = source_audit(frame(spark, made), minimum, top).collect()
    assert sorted(tuple(r) for r in got) == brute(made, minimum, top)


def test_many_rounds_and_no_broadcast(spark, made, monkeypatch):
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    assert sorted(tuple(r) for r in source_audit(frame(spark, made), 2, 1).collect()) == brute(made, 2, 1)


def test_nothing_kept_and_empty(spark, made):
    got = source_audit(frame(spark, made), 10_000).collect()
    assert sorted(tuple(r) for r in got) == brute(made, 10_000, 50) and {r.value for r in got} == {0}
    assert source_audit(frame(spark, [])).count() == 0


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits: ten thousand million occurrences of a term."""
    counts = spark.createDataFrame([("en", "a", "x", 10_000_000_019, 40), ("en", "a", "y", 3, 40), ("en", "b", "x", 7, 40), ("en", "a", None, 0, 0), ("en", "b", None, 0, 0)], "lang string, source string, term string, n long, docs long")
    rows, groups = divergence.postings(counts)
    got = {(r.source, r.term): (r.p, r.q) for r in rows.collect()}
    n = {"a": 10_000_000_022, "b": 7}
    p = lambda c, total: 1 + 10**9 * (c + 5) // (total + 10)
    whole = {"x": p(10_000_000_026, 10_000_000_029), "y": p(3, 10_000_000_029)}
    assert got == {("a", "x"): (p(10_000_000_019, n["a"]), whole["x"]), ("a", "y"): (p(3, n["a"]), whole["y"]), ("b", "x"): (p(7, n["b"]), whole["x"])}
