import hashlib
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from fernlode.functions.text import bpe_counter
from fernlode.operators import chains, codemap, context, edits, evidence, flow, graph, policy, search
from fernlode.operators.adapters import Operators
from fernlode.sources import logs
from fernlode.sources.git import GitError, git, history


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_tiers_patterns_and_rules(spark):
    names = spark.createDataFrame([("read_file",), ("edit",), ("run_it",), ("remember",)], "tool string")
    assert [r.t for r in names.select(policy.tool_tier(F.col("tool")).alias("t")).collect()] == ["read_only", "edit", "exec", "read_only"]
    assert [r.t for r in names.select(policy.allowed_without_asking(F.col("tool"), "edit").alias("t")).collect()] == [True, True, False, True]
    cases = [("a*c", "abc", True), ("a*c", "ac", True), ("a*c", "acd", False), ("*", "", True), ("a.c", "abc", False), ("**x", "yx", True), ("", "", True), ("", "a", False), ("a*\n", "ab\n", True)]
    for pattern, text, expect in cases:
        assert one(spark, t=text).select(policy.pattern_matches(F.col("t"), pattern)).first()[0] is expect, (pattern, text)
    assert {r.tool: r.decision for r in policy.decide(names, [("re*", "allow"), ("remember", "deny")]).collect()} == {"read_file": "allow", "edit": "ask", "run_it": "ask", "remember": "allow"}


def test_policy_hashes(spark):
    sealed = policy.seal_policy({"policy_version": "old", "rules": ["b", "a"]})
    assert sealed == policy.seal_policy(sealed) and sealed["policy_version"] == hashlib.sha256(b'{"policy_version":"","rules":["b","a"]}').hexdigest()
    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), (None,)], "j string").select(policy.json_hash("j").alias("h")).collect()
    assert rows[0].h == rows[1].h == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest() and rows[2].h is None
    own = one(spark, policy_version="v", allowed=True)
    assert own.select(policy.decision_hash(F.struct("policy_version", "allowed"))).first()[0] == hashlib.sha256(b'{"policy_version":"v","allowed":true}').hexdigest()


def test_remember(spark):
    facts = [("p", 1, " one "), ("p", 2, "one"), ("p", 3, "x" * 60), ("p", 4, "two"), ("p", 5, " "), ("q", 1, "three")]
    rows = policy.remember(spark.createDataFrame(facts, "project string, seq long, fact string"), cap=90).orderBy("project", "place").collect()
    assert [tuple(r) for r in rows] == [("p", 0, "one"), ("p", 1, "two"), ("q", 0, "three")]
    block = policy.recall_block(["one", "two"])
    assert len(block) == len(policy.MEMORY_HEADER) + 12 and policy.recall_block([]) is None


def test_adapters_come_first():
    operators = Operators({"size": lambda path: len(path), "name": lambda: "core"})
    operators.adapt(lambda name, arguments: "adapted" if name == "name" else None)
    assert operators.call("name") == "adapted" and operators.call("size", path="abc") == 3 and operators.names() == ["name", "size"]
    with pytest.raises(KeyError):
        operators.call("other")


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("1\n2\n")
    run("add", "."), run("commit", "-qm", "first")
    (tmp_path / "a.txt").write_text("1\n3\n4\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    run("add", "."), run("commit", "-qm", "second")
    (tmp_path / "a.txt").write_text("1\n")
    root = str(tmp_path)
    assert " M a.txt" in git(root, "status") and git(root, "log").count("\n") == 2 and git(root, "log", limit=1).endswith("second\n")
    assert "-3" in git(root, "diff") and "1 file changed" in git(root, "diff", detail="summary") and git(root, "diff", detail="files") == "M\ta.txt\n"
    assert "1 file changed" in git(root, "diff", detail="bundle") and git(root, "diff", staged=True) == "" and "second" in git(root, "show") and "3" in git(root, "blame", "a.txt", rev="HEAD")
    assert git(root, "show", max_chars=5).endswith("more characters")
    for bad in ({"op": "push"}, {"op": "diff", "path": "../x"}, {"op": "diff", "path": "/x"}, {"op": "log", "rev": "--all"}, {"op": "blame"}, {"op": "diff", "detail": "x"}, {"op": "log", "max_chars": 0}, {"op": "show", "rev": "none"}):
        with pytest.raises(GitError):
            git(root, **bad)
    rows = history(spark, root).groupBy("path").agg(F.count("*").alias("n"), F.sum("insertions").alias("i"), F.sum("deletions").alias("d")).collect()
    assert {tuple(r) for r in rows} == {("a.txt", 2, 4, 1), ("b.bin", 1, None, None)}


def test_plans_are_applied_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda plan: [tuple(r) for r in plan.collect()]
    assert edits.apply_plan(root, rows(edits.plan_write(spark, {"a/x.txt": "one", "b.txt": "two"}))) == ["a/x.txt", "b.txt"]
    assert edits.apply_plan(root, rows(edits.plan_move(spark, {"b.txt": "c/d.txt"}))) == ["b.txt", "c/d.txt"] and (tmp_path / "c/d.txt").read_text() == "two"
    for bad in ([("a/x.txt", "delete", None, None), ("none", "delete", None, None)], [("../x", "write", None, "")], [("a/x.txt", "write", None, "1"), ("a/x.txt", "delete", None, None)], [("a/x.txt", "move", "c/d.txt", None)], [("a/x.txt", "burn", None, None)], [("", "write", None, "x")]):
        with pytest.raises(edits.EditError):
            edits.apply_plan(root, bad)
    os.mkdir(tmp_path / "dir")
    with pytest.raises(edits.EditError):  # fails while it is applied: a folder stands in the way
        edits.apply_plan(root, [("a/x.txt", "write", None, "changed"), ("a/new.txt", "write", None, "new"), ("dir", "write", None, "x")])
    assert (tmp_path / "a/x.txt").read_text() == "one" and not (tmp_path / "a/new.txt").exists()
    assert edits.apply_plan(root, rows(edits.plan_delete(spark, ["a/x.txt"]))) == ["a/x.txt"] and not (tmp_path / "a/x.txt").exists()


def test_syntax_issues():
    assert codemap.syntax_issues('def f(x):\n  return (x]\n# )\n"("', "python") == [(2, "unclosed ("), (2, "unexpected ]")]
    assert codemap.syntax_issues("fn a<'a>() { let c = '('; /* } */ }", "rust") == [] and codemap.syntax_issues("a(\n[\n)", "go") == [(2, "unclosed [")]
    assert codemap.syntax_issues("(((", None) == [] and len(codemap.syntax_issues(")\n" * 50, "go")) == 20


def test_tokens_of_a_vocabulary(spark, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"th", b"the"]
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    rows = spark.createDataFrame([("the",), ("th e",), ("",), (None,)], "t string").select(bpe_counter(str(tmp_path / "v"))("t")).collect()
    assert [r[0] for r in rows] == [1, 3, 0, None]


def test_secrets_within_slices(spark):
    key = "-----BEGIN PRIVATE KEY-----\nabc\ndef\n-----END PRIVATE KEY-----\nplain\nghp_" + "x" * 20
    corpus = spark.createDataFrame([("r", "k", key), ("r", "open", "x\n-----BEGIN RSA PRIVATE KEY-----\na\nb")], "root_id string, rel_path string, text string")
    slices = lambda *rows: spark.createDataFrame([("r", *row) for row in rows], "root_id string, rel_path string, start_line long, end_line long")
    found = lambda *rows: sorted((r.rel_path, r.line, r.kind) for r in context.secret_slices(corpus, slices(*rows)).collect())
    assert found(("k", 2, 3)) == [("k", 2, "private_key_block")] and found(("k", 5, 5)) == [] and found(("k", 6, 6)) == [("k", 6, "github_token")]
    assert found(("open", 4, 4), ("open", 1, 1)) == [("open", 4, "private_key_block")]


def test_search_additions(spark):
    assert search.checked_pattern(spark, "a+", True) == (True, []) and search.checked_pattern(spark, "a(", False) == (False, [])
    regex, said = search.checked_pattern(spark, "a(", True, literal_fallback=True)
    assert not regex and len(said) == 1
    with pytest.raises(ValueError):
        search.checked_pattern(spark, "a(", True)
    corpus = spark.createDataFrame([("r", "a", "x\nneedle\nneedle"), ("r", "b", "\x00needle"), ("s", "c", "none")], "root_id string, rel_path string, text string")
    assert tuple(search.search_report(corpus, "needle", 1).first()) == (2, 19, 1, 1, 2, 1, 1)
    roots = spark.createDataFrame([("r", "/x/base/")], "root_id string, root_path string")
    assert {r.display_path for r in search.display_path(corpus.select("root_id", "rel_path"), roots).collect()} == {"base/a", "base/b", "c"}
    hits = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b")], "root_id string, rel_path string")
    assert [tuple(r) for r in search.top_content_files(hits).orderBy("rel_path").collect()] == [("r", "a", 2), ("r", "b", 1)] and search.top_content_files(hits.limit(2).filter("rel_path = 'a'")).count() == 0
    paths = spark.createDataFrame([("a/b",), ("a/bc",), ("a/b/c",)], "rel_path string")
    assert {r.rel_path for r in search.code_scope(paths, ["a/b"]).collect()} == {"a/b", "a/b/c"} and search.code_scope(paths, []).count() == 3


def test_changes_ranks_and_replay(spark):
    diff = "--- a/f\n+++ b/f\n@@ -2,2 +2,2 @@\n-x\n+y\n z\n"
    symbols = spark.createDataFrame([("f", "one", "function", 1, 1, 3), ("f", "two", "function", 4, 4, 900), ("g", "one", "function", 1, 1, 3)], "path string, name string, kind string, line long, start_line long, end_line long")
    assert [tuple(r) for r in graph.detect_changes(spark.createDataFrame([("d", diff)], "diff_id string, diff string"), symbols).collect()] == [("f", "one", "function", 1, 3, 1)]
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    rank = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}
    for _ in range(30):
        rank = {"a": 0.05 + 0.85 * rank["c"] / 3, "b": 0.05 + 0.85 * (rank["a"] * 2 / 3 + rank["c"] / 3), "c": 0.05 + 0.85 * (rank["a"] / 3 + rank["b"] + rank["c"] / 3)}
    got = {r.node: r["rank"] for r in graph.pagerank(edges, nodes).collect()}
    assert all(abs(got[k] - v) < 1e-12 for k, v in rank.items())
    tape = spark.createDataFrame([("r", 0, "aa"), ("r", 1, "bb")], "run_id string, seq long, event_hash string")
    first = hashlib.sha256(b"aa").hexdigest()
    assert [r.chained_hash for r in chains.replay_progress(tape).orderBy("seq").collect()] == [first, hashlib.sha256((first + "bb").encode()).hexdigest()]
    verdicts = spark.createDataFrame([("v", "r"), ("w", "q")], "verdict_id string, run_id string")
    assert evidence.verdict_query(verdicts, "r").count() == 1 and evidence.verdict_query(verdicts).count() == 2


def test_documents_of_other_keys_stay(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    logs.write_documents(rows, str(tmp_path / "d"), "id")
    logs.write_documents(spark.createDataFrame([("b", 3)], "id string, n long"), str(tmp_path / "d"), "id")
    assert {(r.id, r.n) for r in spark.read.json(str(tmp_path / "d")).collect()} == {("a", 1), ("b", 3)}


def test_heads_follow_the_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "log string, seq long, hash string")
    logs.append_with_heads(rows, str(tmp_path / "l"), "log", "seq")
    logs.append_with_heads(spark.createDataFrame([("b", 1, "w")], rows.schema), str(tmp_path / "l"), "log", "seq")
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    assert {(r.log, r.seq, r.hash) for r in spark.read.json(str(tmp_path / "l-heads")).collect()} == {("a", 1, "y"), ("b", 1, "w")}


def test_path_scope_of_roots(spark):
    rows = spark.createDataFrame([("r", "a/x"), ("r", "b"), ("s", "r/a/x"), ("s", "c")], "root_id string, rel_path string")
    found = lambda path, roots=None: sorted(tuple(r) for r in search.path_scope(rows, path, roots).collect())
    assert found("r/a") == [("s", "r/a/x")] and found("r/b") == [("r", "b")] and found("s/c") == [("s", "c")]  # what stands as it is wins
    assert found("base/b", {"r": "/x/base"}) == [("r", "b")] and found("base/b", {"r": "/x/base", "s": "/y/base/"}) == [] and found("r") == [("s", "r/a/x")] and found("") == []


def test_diffs_of_a_plan(spark):
    corpus = spark.createDataFrame([("f", "a\nb\n"), ("g", "same")], "rel_path string, text string")
    plan = spark.createDataFrame([("f", "update", None, "a\nc\n"), ("g", "update", None, "same"), ("n", "write", None, "new\n"), ("d", "delete", None, None)], edits.PLAN_DDL)
    got = {r.path: r.diff for r in edits.plan_diffs(corpus, plan).collect()}
    assert got.keys() == {"f", "n"} and "-b\n+c" in got["f"] and "+new" in got["n"]


def test_flows_run_phase_by_phase(spark):
    flows = spark.createDataFrame([(k, s, 2, 1, 2) for k, s in enumerate(flow.STRATEGIES)] + [(90, "debate", 2, 0, 1), (91, "parallel", 0, 0, 0), (92, "unknown", 1, 1, 1)], "flow_id long, strategy string, n int, rounds int, k int")
    nodes, started, results = flow.compile_flows(flows), [], []
    order = {}
    for _ in range(6):
        frames = spark.createDataFrame(started, "flow_id long, node string"), spark.createDataFrame(results, "flow_id long, node string, ok boolean")
        actions = sorted(map(tuple, flow.next_actions(nodes, *frames).collect()), key=str)
        begun = [(f, n) for f, a, n, _ in actions if a == "start"]
        for f, n in begun:
            order.setdefault(f, []).append(n)
        started += begun
        # Everything goes well but the second candidate of the vote.
        results += [(f, n, n != "candidate1") for f, n in begun]
        if not begun:
            break
    ends = {f: ok for f, a, _, ok in actions if a == "finish"}
    assert ends == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert order[2] == ["step0", "step1"] and order[3] == ["map0", "map1", "reduce0"] and order[4] == ["candidate0", "candidate1"] and order[5] == ["turn0-0", "turn0-1", "judge0"] and order[6] == ["plan0", "worker0", "worker1", "summary0"] and order.keys() == set(range(7))
    waiting = flow.next_actions(nodes.filter("flow_id = 0"), spark.createDataFrame([(0, "step0")], "flow_id long, node string"), spark.createDataFrame([], "flow_id long, node string, ok boolean"))
    assert waiting.count() == 0
