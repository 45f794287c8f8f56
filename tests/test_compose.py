import pytest
from pyspark.sql import functions as F

from fernlode.operators import codemap, compose, context, edits


@pytest.fixture(scope="module")
def corpus(spark):
    files = [("r", "pkg/lib.py", "def target(a):\n    return a\n"), ("r", "main.py", "from pkg.lib import target\n\ndef go():\n    return target(1)\n"), ("r", "alias.py", "from pkg.lib import target as t\n\ndef run():\n    return t(2)\n"), ("r", "other.py", "x = 1\n"), ("r", "notes.txt", "target " * 300)]
    return spark.createDataFrame(files, "root_id string, rel_path string, text string")


def test_build_context(spark, corpus):
    ranks = spark.createDataFrame([("pkg/lib.py", 0.6), ("main.py", 0.4)], "path string, rank double")
    got = compose.build_context(corpus, ranks, "target", 120, 3)
    assert got["tokens"] <= 120 and {"pkg/lib.py", "main.py"} <= {i["path"] for i in got["included"]} and got["context"].startswith("## ") and len(got["hash"]) == 32
    assert any(e["path"] == "notes.txt" and e["reason"] == "budget" for e in got["excluded"]) or any(i["path"] == "notes.txt" and i["mode"] == "slices" for i in got["included"])


def test_workspace_and_map():
    got = compose.workspace_context({"contents": "c", "file_map": "m", "tree": "t"})
    assert got["context"] == "<file_map>\nm\n</file_map>\n\n<contents>\nc\n</contents>" and got["section_tokens"] == {"file_map": 1, "contents": 1}
    assert compose.render_map([("a" * 50, "1"), ("b", "2")], 20) == "1 " + "a" * 50


def test_tree(corpus):
    nodes = context.file_tree(corpus.withColumn("size", F.octet_length("text")))
    assert compose.render_tree(nodes).split("\n") == ["pkg/", "  lib.py", "alias.py", "main.py", "notes.txt", "other.py"]
    assert compose.render_tree(nodes, "folders") == "pkg/" and len(compose.render_tree(nodes, cap=10)) <= 10


def test_snapped_range():
    text = "def f():\n    a\n    b\n\nx = 1\n"
    assert compose.snapped_range(text, "f.py", 2, 2)["first"] == 1 and not compose.snapped_range(text, "f.txt", 2, 2)["snapped"] and not compose.snapped_range(text, "f.py", 5, 5)["snapped"]


def test_rename(spark, corpus):
    parsed = codemap.parse_corpus(corpus)
    symbols, refs = codemap.symbol_table(parsed).drop("root_id"), codemap.reference_table(parsed).drop("root_id")
    plan = {r.path: r.text for r in compose.rename_plan(symbols, refs, corpus, "target", "goal", "pkg/lib.py").collect()}
    assert plan == {"pkg/lib.py": "def goal(a):\n    return a\n", "main.py": "from pkg.lib import goal\n\ndef go():\n    return goal(1)\n", "alias.py": "from pkg.lib import goal as t\n\ndef run():\n    return t(2)\n"}
    clash = corpus.withColumn("text", F.when(F.col("rel_path") == "main.py", F.concat("text", F.lit("target = 3\n"))).otherwise(F.col("text")))
    with pytest.raises(edits.EditError):
        compose.rename_plan(symbols, refs, clash, "target", "goal", "pkg/lib.py").collect()
