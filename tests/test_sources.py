import json
import os

import pytest
from pyspark.sql import functions as F

from fernlode.operators import codemap, edits
from fernlode.operators.search import Matcher, content_search, hashline_view, is_binary, path_scope, path_search
from fernlode.sources import catalog, logs


def put(root, files):
    for path, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        open(f"{root}/{path}", "w").write(body)


def test_scan(spark, tmp_path):
    put(tmp_path, {"a.rs": "x", ".hidden": "h", "node_modules/x.js": "", ".git/config": "", "out/a.log": "", "out/keep.log": "", "sub/.gitignore": "*.tmp\n!b.tmp\n", "sub/a.tmp": "t", "sub/b.tmp": "t", "build/x": "", ".gitignore": "*.log\n!keep.log\nbuild/\n# c\n"})
    got = {r.rel_path for r in catalog.scan(spark, {"r": str(tmp_path)}).collect()}
    assert got == {"a.rs", ".hidden", "out/keep.log", "sub/.gitignore", "sub/b.tmp", ".gitignore"}
    rows, said = catalog.finalize(catalog.scan(spark, {"r": str(tmp_path), "q": str(tmp_path)}), 3)
    assert [(r.rel_path, r.root_id) for r in rows.collect()][:2] == [(".gitignore", "q"), (".gitignore", "r")] and "12" in said[0]
    bodies = catalog.read_bodies(spark, str(tmp_path / "sub"))
    assert [r.t for r in bodies.select(catalog.decode().alias("t")).collect()] == ["t", "t"]  # hidden and empty files have no body row


def test_host_files(spark):
    rows = catalog.host_files(spark, [("a/./b.txt", b"x\x00"), ("c", b"\xff ok")])
    assert {(r.rel_path, r.b) for r in rows.select("rel_path", is_binary(F.col("content")).alias("b")).collect()} == {("a/b.txt", True), ("c", False)}
    assert rows.filter("rel_path = 'c'").select(catalog.decode()).first()[0] == "� ok"
    with pytest.raises(ValueError):
        catalog.host_files(spark, [("../x", b"")])


def test_logs(spark, tmp_path):
    (tmp_path / "log.ndjson").write_text('{"seq":0,"kind":"a"}\n\nbroken\n{"seq":1,"kind":"b","schema_version":9}\n{"seq":2,"kind":"c","schema_version":1}\n')
    assert [r.seq for r in logs.read_ndjson(spark, str(tmp_path / "log.ndjson"), "seq long, kind string, schema_version int").orderBy("seq").collect()] == [0, 2]
    assert logs.read_ndjson(spark, str(tmp_path / "none"), "seq long").count() == 0
    put(tmp_path, {"docs/a.json": '{\n"id": "a"}', "docs/b.json": "nope", "docs/c.txt": "{}"})
    assert [r.id for r in logs.read_json_folder(spark, str(tmp_path / "docs"), "id string").collect()] == ["a"]
    frame = spark.createDataFrame([(1, "x"), (2, "y")], "seq long, k string")
    for _ in range(2):
        logs.append_ndjson(frame, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "tape.jsonl").write_text('{"seq":0,"node_id":"n","payload":"p"}\nbroken\n')
    with pytest.raises(Exception):
        logs.read_tape(spark, str(tmp_path / "tape.jsonl")).collect()


def test_traces(spark):
    span = lambda i, t, a: {"spanId": i, "startTimeUnixNano": str(t), "attributes": a}
    listed = {"resourceSpans": [{"scopeSpans": [{"spans": [span("s2", 2000, [{"key": "gen_ai.usage.input_tokens", "value": {"intValue": "7"}}]), span("s1", 1000, [{"key": "gen_ai.completion", "value": {"stringValue": "hi"}}])]}]}]}
    flat = {"spans": [span("s1", 1000, {"gen_ai.completion": "hi"}), span("s2", 2000, {"gen_ai.usage.input_tokens": 7})]}
    frame = spark.createDataFrame([("a", json.dumps(listed)), ("b", json.dumps(flat)), ("c", "bad")], "trace_id string, body string")
    tape = logs.trace_to_tape(logs.trace_spans(frame)).orderBy("trace_id", "seq").collect()
    own = lambda t: [(r.seq, r.kind, r.text, r.input_tokens) for r in tape if r.trace_id == t]
    assert own("a") == own("b") and [r[1] for r in own("a")] == ["run_started", "output", "usage_updated", "output", "usage_updated", "run_finished"] and own("a")[4][3] == 7 and not own("c")


DIFF = "--- a/x.rs\n+++ b/x.rs\n@@ -1,3 +1,4 @@\n a\n-b\n+B\n++++ c\n d\n\\ No newline at end of file\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"


def test_diff_and_numstat(spark):
    assert logs.parse_diff(DIFF) == [("x.rs", 2), ("x.rs", 3)]
    frame = spark.createDataFrame([(1, DIFF)], "diff_id int, diff string")
    assert logs.changed_lines(frame).count() == 2
    stat = spark.createDataFrame([("3\t1\ta.rs\x00-\t-\tb.png\x00",)], "t string").select(F.inline(logs.parse_numstat(F.col("t"))))
    assert [tuple(r) for r in stat.collect()] == [(3, 1, "a.rs"), (None, None, "b.png")]


def test_search_on_files(spark):
    corpus = spark.createDataFrame([("r", "a.rs", "needle here\nno\nNeedle é needle\n"), ("r", "b/c.rs", "x\nneedles"), ("r", "d", "")], "root_id string, rel_path string, text string")
    got = content_search(corpus, "needle", max_results=10)
    assert [(r.rel_path, r.line, r.column) for r in got.collect()] in ([("a.rs", 1, 1), ("b/c.rs", 2, 1), ("a.rs", 3, 1)], [("b/c.rs", 2, 1), ("a.rs", 1, 1), ("a.rs", 3, 1)])
    assert content_search(corpus, "needle", whole_word=True, max_results=None).count() == 2 and content_search(corpus, "Needle", max_results=None).count() == 1
    assert corpus.select(Matcher("é").column(F.col("text"))).first()[0] == 23
    entries = corpus.withColumn("size", F.octet_length("text"))
    assert [r.rel_path for r in path_search(entries, "c.rs").collect()] == ["b/c.rs"] and path_scope(entries, "b").count() == 1 and path_scope(entries, "").count() == 0
    assert hashline_view(corpus).filter("rel_path = 'd'").first()[2].endswith("]\n1:")


RUST = "use lib::Kind;\n\npub struct A {\n    x: i32,\n}\n\nimpl A {\n    pub fn go(&self) -> i32 {\n        helper(Kind::new(1))\n    }\n}\n"


def test_code_map(spark):
    files = [("r", "a.rs", RUST), ("r", "b.py", "import os\n\nclass C:\n    def m(self):\n        return os.name\n\nLIMIT = 3\n"), ("r", "c.js", "import x from './y';\nexport const f = (a) => {\n  return x(a);\n};\n"), ("r", "d.md", "# t\n```rust\nfn inner() {}\n```\n"), ("r", "e.txt", "fn no() {}")]
    parsed = codemap.parse_corpus(spark.createDataFrame(files, "root_id string, rel_path string, text string"))
    names = {(r.path, r.kind, r.name, r.start_line, r.end_line) for r in codemap.symbol_table(parsed).collect()}
    assert names == {("a.rs", "struct", "A", 3, 5), ("a.rs", "impl", "A", 7, 11), ("a.rs", "function", "go", 8, 10), ("b.py", "class", "C", 3, 5), ("b.py", "function", "m", 4, 5), ("b.py", "constant", "LIMIT", 7, 7), ("c.js", "function", "f", 2, 4), ("d.md", "function", "inner", 3, 3)}
    refs = {(r.path, r.kind, r.name, r.import_path) for r in codemap.reference_table(parsed).collect()}
    assert {("a.rs", "import", "Kind", "lib::Kind"), ("a.rs", "call", "helper", None), ("b.py", "import", "os", "os"), ("c.js", "import", "y", "./y"), ("c.js", "call", "x", None)} <= refs
    assert codemap.code_structure(parsed).filter("path = 'a.rs'").first().text.split("\n")[0] == "struct pub struct A"
    assert codemap.smallest_block(RUST, "rust", 9, 9) == (8, 10) and codemap.symbols_of(RUST, "rust")[1]["members"] == ["go"]
    long = "fn f() {\n" + "    a();\n" * 6 + "}\n"
    assert (2, 7, False) in codemap.summarize(long, "rust") and codemap.summarize("plain\ntext", None) == [(1, 2, True)]
    assert codemap.ast_edit("foo(a, a); foo(a, b)", "foo($X, $X)", "bar(${X})") == "bar(a); foo(a, b)"
    with pytest.raises(ValueError):
        codemap.ast_search("x", "(#eq? a b)")


def test_edits(spark):
    assert edits.replace("a\r\nb\r\n", "b", "c") == "a\r\nc\r\n" and edits.replace("if (x) {\n y }", "if(x){", "while(x){") == "while(x){\n y }"
    for bad in (("aa", "a", "b"), ("x", "y", "z"), ("x", "", "z")):
        with pytest.raises(edits.EditError):
            edits.replace(*bad)
    assert edits.replace("aa", "a", "b", True) == "bb"
    assert edits.patch("one\ntwo\nthree", "@@\n one\n-two\n+2\n+2b") == "one\n2\n2b\nthree"
    with pytest.raises(edits.EditError):
        edits.patch("x\nx", "@@\n-x\n+y")
    doc = "*** Begin Patch\n*** Add File: n\n+new\n*** Update File: a\n*** Move to: b\n@@\n-x\n+y\n*** Delete File: d\n*** End Patch"
    assert edits.apply_patch({"a": "x", "d": ""}, doc) == [("n", "create", None, "new\n"), ("a", "rename", "b", "y"), ("d", "delete", None, None)]
    for bad in (doc.replace("*** End Patch", ""), doc.replace("*** Delete File: d", "*** Delete File: q"), "*** Begin Patch\n*** End Patch"):
        with pytest.raises(edits.EditError):
            edits.apply_patch({"a": "x", "d": ""}, bad)
    t = "l1\nl2\nl3"
    assert edits.hashline(t, edits.tag(t).lower(), [{"op": "replace", "line": 2, "text": "L2"}, {"op": "insert_after", "line": 2, "text": "new"}, {"op": "append", "text": "end"}]) == "l1\nL2\nnew\nl3\nend"
    for ops in ([{"op": "replace", "line": 1, "end": 2, "text": ""}, {"op": "delete", "line": 2}], [{"op": "replace", "line": 1, "end": 3, "text": ""}, {"op": "insert_after", "line": 1, "text": ""}], [{"op": "delete", "line": 9}]):
        with pytest.raises(edits.EditError):
            edits.hashline(t, edits.tag(t), ops)
    with pytest.raises(edits.EditError):
        edits.hashline(t, "0", [])
    assert edits.rebase_ranges("a\nb\nc\nd\ne", "a\nX\nb\nc\nd\ne", [(1, 1), (4, 5)]) == ([(1, 1), (5, 6)], [])
    assert edits.rename_in("foo food foo_", "foo", "bar") == "bar food foo_" and edits.replace_symbol("a\nb\nc", [(2, 2)], "B", "after") == "a\nb\nB\nc"
    assert edits.unified_diff("a\n", "b\n", "f").startswith("--- a/f\n+++ b/f\n") and edits.unified_diff("a b\n", "ab\n", "f", ignore_space=True) == ""
    corpus = spark.createDataFrame([("f", "x y x"), ("g", "x")], "rel_path string, text string")
    assert {(r.path, r.action) for r in edits.plan_replace(corpus, "x", "z").collect()} == {("f", "error: 2 matches"), ("g", "update")}
    assert [r.text for r in edits.plan_rename(corpus, spark.createDataFrame([("f", 1)], "path string, line long"), "y", "q").collect()] == ["x q x"]
