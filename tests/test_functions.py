import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernlode.functions import hashing, text


LETTERS = re.compile("[a-z0-9]+")
INNER_EDGE = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbB1_2 cCé-", max_size=14))
def test_field_terms_are_the_field_cut_at_its_edges(field):
    spaced = "".join(c if c.isascii() and c.isalnum() else " " for c in INNER_EDGE.sub(" ", field))
    terms = text.field_terms(field)
    assert terms == LETTERS.findall(spaced.lower())
    assert "".join(terms) == "".join(c.lower() for c in field if c.isascii() and c.isalnum())


def test_identifier_terms_split_words_and_leave_out_short_and_stop_words():
    terms = set(text.identifier_terms("OrderLedger close_month XMLReader it"))
    assert {"order", "ledger", "close", "month", "xml", "reader"} <= terms
    assert all(len(t) > 1 for t in terms)


def rows(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select(*columns).collect()]


def test_lines(spark):
    got = rows(spark, ["a\nb\n", "a\r\nb", "", "a\n\n", "a\rb"], text.lines(F.col("v")))
    assert got == [(["a", "b"],), (["a", "b"],), ([],), (["a", ""],), (["a\rb"],)]


def test_tokens_and_scores(spark):
    assert rows(spark, ["Été x2, ⅷ²!"], text.tokenize_text(F.col("v"))) == [(["été", "x2", "ⅷ²"],)]
    assert rows(spark, ["fooBar", "foo_x", "food", "xfoo", "foo"], text.field_score(F.col("v"), "foo", 80)) == [(160,), (160,), (80,), (40,), (320,)]
    assert rows(spark, ["parseHTTPServer2x_fooBar"], text.field_terms_column(F.col("v"))) == [(["parse", "http", "server2x", "foo", "bar"],)]
    assert rows(spark, ["a/b.RS", "x.tsx", "none", "d.d/none"], text.language_from_path(F.col("v"))) == [("rust",), ("tsx",), (None,), (None,)]
    assert rows(spark, ["k = v", "k: v", "k=", "a=:b", "none"], *text.split_assignment(F.col("v"))) == [("k ", " v"), ("k", " v"), (None, None), ("a", ":b"), (None, None)]


@pytest.mark.parametrize("glob,yes,no", [("*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx"]), ("src/*.py", ["src/a.py"], ["src/b/a.py", "x/src/a.py"]), ("**/en/**", ["en/a", "x/en/a/b"], ["xen/a"]), ("a?[bc].{x,yy}", ["q/azb.yy"], ["azd.x"])])
def test_globs(glob, yes, no):
    rule = re.compile(text.glob_regex(glob))
    assert all(rule.match(p) for p in yes) and not any(rule.match(p) for p in no)


def test_languages_and_paths():
    assert text.language_from_shebang("#!/usr/bin/env -S python3.11\n") == "python" and text.language_from_shebang("#!/bin/node") == "javascript" and text.language_from_shebang("x") is None
    assert text.language_from_fence("rust,ignore") == "rust" and text.language_from_fence("") is None
    assert text.normalize_path("a/./b/../c\\d") == "a/c/d" and text.normalize_path("../x") is None
    assert text.render_template("{{a}} {{b}} {{", {"a": "1"}) == "1 {{b}} {{" and text.coerce_int("3.0") == 3 and text.coerce_int(2.5) is None


def test_numbers(spark):
    d = spark.createDataFrame([(1.5, 1, 3), (-1.0, 2, 0), (float("nan"), 1, 1)], "usd double, a long, b long")
    assert [tuple(r) for r in d.select(text.usd_to_micro(F.col("usd")), text.permille(F.col("a"), F.col("b"))).collect()] == [(1_500_000, 333), (None, 0), (None, 1000)]
    assert rows(spark, ["1"], text.epoch_text(F.lit(0)))[0][0] == "1970-01-01T00:00:00Z"


def test_hashes(spark):
    assert hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C and len(hashing.context_hash("x")) == 32
    assert rows(spark, ["a  \nb"], hashing.content_tag("v")) == rows(spark, ["a\nb"], hashing.content_tag("v"))
    assert rows(spark, ["é"], hashing.dsse_pae(F.lit("t"), F.col("v"))) == [("DSSEv1 1 t 2 é",)]
    assert rows(spark, ["{}"], F.hex(hashing.u64_le(F.lit(258).cast("long")))) == [("0201000000000000",)]
    assert hashing.snapshot_digest([("r", "b", 1), ("r", "a", 2)]) == hashing.snapshot_digest([("r", "a", 2), ("r", "b", 1)])
    assert hashing.hash_canonical({"b": 1, "a": 2}) == hashing.hash_canonical({"a": 2, "b": 1})
