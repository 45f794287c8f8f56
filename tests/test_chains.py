from pyspark.sql import functions as F

from fernlode.operators import chains, evidence

TAPE = "run_id string, seq long, kind string, agent string, task string, cwd string, turn long, text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cost_micro_usd long, ok boolean, exit_code int, timed_out boolean"
# A tape and its chain's root, which the hashes must reproduce.
ROWS = [
    {"kind": "run_started", "agent": "codex", "task": "add a regression test for the parser", "cwd": "/repo"},
    {"kind": "turn_started", "turn": 0},
    {"kind": "output", "turn": 0, "text": "reading src/parser.rs"},
    {"kind": "output", "turn": 0, "text": "applied edit to tests/parser.rs"},
    {"kind": "usage_updated", "turn": 0, "input_tokens": 1200, "output_tokens": 340, "cache_read_tokens": 800, "cache_creation_tokens": 0, "cost_micro_usd": 4200},
    {"kind": "turn_finished", "turn": 0, "ok": True},
    {"kind": "run_finished", "ok": True, "exit_code": 0, "timed_out": False},
]
ROOT = "452918524e4c422114d11038d93e628bee2e8955d34eea549fc4fe19419a1a2a"


def tape(spark):
    names = [c.split(" ")[0] for c in TAPE.split(", ")]
    return spark.createDataFrame([tuple({"run_id": "r", "seq": k, **row}.get(n) for n in names) for k, row in enumerate(ROWS)], TAPE)


def test_known_root(spark):
    sealed = chains.seal(chains.hash_events(tape(spark)))
    assert [(r.root_hash, r.events) for r in chains.chain_roots(sealed).collect()] == [(ROOT, 7)]
    roots = chains.chain_roots(sealed)
    assert chains.replay_verify(chains.hash_events(tape(spark)), sealed, roots).first().verified
    changed = chains.hash_events(tape(spark).withColumn("text", F.when(F.col("seq") == 3, "other").otherwise(F.col("text"))))
    bad = chains.replay_verify(changed, sealed, roots).first()
    assert not bad.verified and bad.diverged_at_seq == 3


def test_gate_only_downgrades(spark):
    verdicts = spark.createDataFrame([("a", "passed"), ("b", "passed"), ("c", "failed"), ("d", "passed"), ("e", "inconclusive")], "receipt_id string, verdict string")
    states = spark.createDataFrame([("a", "t", "passed"), ("b", "t", "present_not_passed"), ("c", "t", "passed"), ("d", "t", "missing")], "receipt_id string, name string, state string")
    specs = spark.createDataFrame([("a", "x", "x")], "receipt_id string, checkspec_hash string, expected_checkspec_hash string")
    got = {r.receipt_id: (r.conclusion, r.exit_code) for r in evidence.merge_gate(verdicts, states, specs).collect()}
    assert got == {"a": ("success", 0), "b": ("failure", 1), "c": ("failure", 1), "d": ("neutral", 2), "e": ("neutral", 2)}


def test_folds(spark):
    attempts = spark.createDataFrame([("a", True, False), ("a", True, False), ("b", True, False), ("b", False, False), ("c", False, False), ("d", None, True)], "check_id string, passed boolean, launch_error boolean")
    assert {r.check_id: r.status for r in evidence.rerun_fold(attempts).collect()} == {"a": "pass", "b": "flaky", "c": "fail", "d": "error"}
    checks = spark.createDataFrame([("v", "pass", True), ("v", "error", False), ("w", "flaky", True), ("x", "pass", None)], "verdict_id string, status string, required boolean")
    assert {r.verdict_id: r.status for r in evidence.verdict_status(checks).collect()} == {"v": "passed", "w": "inconclusive", "x": "inconclusive"}
