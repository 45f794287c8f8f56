import random
import re
import time

import pyarrow as pa
import pytest

from fernlode.functions import regex
from fernlode.operators import search


def test_spans_against_python():
    rng = random.Random(3)
    patterns = ["ab+", "(a|b)c?", "[^b]+b", "a{2}", "b?", "a.c", "(?:ab|a)", "(?P<x>é)(_)?", r"\(|[(]|1", r"\w+", r"\d", "ca$", "^b"]
    own = ["".join(rng.choice("abc é_1-") for _ in range(rng.randrange(12))) for _ in range(200)]
    word = lambda t, a, b: (a == 0 or not re.match("[A-Za-z0-9_]", t[a - 1])) and (b == len(t) or not re.match("[A-Za-z0-9_]", t[b]))
    for p in patterns:
        for whole in (False, True) if p != "b?" else (False,):
            hit, at, n = regex.scan(pa.array(own), regex.linear_pattern(p), True, whole)
            got = dict(zip(hit.tolist(), at.tolist()))
            expect = {}
            for k, t in enumerate(own):
                spans = [m.span() for m in re.finditer(p, t)]
                spans = [s for s in spans if not whole or word(t, *s)]
                if spans:
                    expect[k] = len(t[: spans[0][0]].encode())
            assert got == expect, (p, whole)


def test_required_literals_never_lose_a_match():
    rng = random.Random(5)
    atoms = ["a", "b", "k", "S", r"\.", "[ab]", "(a|b)", "(ab)?", ".", "a*", "b?", "c{2}", "x+", r"\w", "é"]
    for _ in range(400):
        p = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "", "|c"])
        for _ in range(20):
            t = "".join(rng.choice("abckS.xéKſ") for _ in range(8))
            for case in (True, False):
                low = t if case else t.translate({k: k + 32 for k in range(65, 91)})
                if re.search(p, t, 0 if case else re.I):
                    assert all(r in low for r in regex.required_literals(p, case)), (p, t)
    assert regex.required_literals("fo+bar.*baz", True) == ["fo", "bar", "baz"] and regex.required_literals("(?i)foo", True) == []


def test_backtracking_patterns_are_linear(spark):
    long = "1,2,3," * 170_000
    corpus = spark.createDataFrame([("r", "a", f"x\n{long}\n{long}P\n"), ("r", "b", ""), ("r", "c", None)], "root_id string, rel_path string, text string")
    start = time.time()
    assert len(regex.scan(pa.array([long]), regex.linear_pattern("(.*,){11}P"), True, False)[0]) == 0 and time.time() - start < 1
    rows = search.matching_lines(corpus, search.Matcher("(.*,){11}P", regex=True)).collect()
    assert [(r.rel_path, r.line, r.column, r.occurrences) for r in rows] == [("a", 3, 1, 1)]


def test_refused_patterns():
    for bad in ("(?=a)b", "(?<!a)b", r"(a)\1", "a("):
        with pytest.raises(ValueError):
            search.Matcher(bad, regex=True)


def test_regex_searches(spark):
    corpus = spark.createDataFrame([("r", "a", "éé foo\nno\nFoo foo_x fooo\n"), ("r", "b", "foo\0"), ("r", "c", "bar")], "root_id string, rel_path string, text string")
    rows = search.content_search(corpus, "fo+", regex=True, max_results=None).orderBy("line").collect()
    assert [(r.rel_path, r.line, r.column) for r in rows] == [("a", 1, 6), ("a", 3, 1)]
    whole = search.match_files(corpus, "fo+", regex=True, whole_word=True).collect()
    assert [(r.rel_path, r["count"], r.occurrences) for r in whole] == [("a", 2, 3)]
    context = search.line_context(corpus, "^no$", 1, 1, regex=True).collect()
    assert [(r.line, [(c.line, c.text) for c in r.context]) for r in context] == [(2, [(1, "éé foo"), (2, "no"), (3, "Foo foo_x fooo")])]
    assert [(r.rel_path, r.score) for r in search.path_search(corpus, "[ac]$", regex=True).collect()] == [("a", 899_999), ("c", 899_999)]
