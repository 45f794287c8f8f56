"""Evidence queries over ``events``, ``conversations`` and ``labels``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.operators import chains, evidence


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcome labels: every user is a run, one agent in 8 is unknown."""
    e = _events(spark, sf_dir)
    outcome = F.when(F.col("event_type") == "purchase", "merged").when(F.col("event_type") == "signup", "shipped_no_regress").when((F.col("event_type") == "error") & (F.col("value") > 45), "reverted").when((F.col("event_type") == "error") & (F.col("value") > 40), "incident")
    rows = e.select((F.col("event_id") % 4001).alias("run_id"), F.when(F.col("event_id") % 4001 % 8 > 0, F.concat(F.lit("agent"), F.col("event_id") % 4001 % 8)).alias("agent"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.lit("ci").alias("source"))
    return rows.filter("outcome IS NOT NULL")


_LABELS = """lb AS (SELECT event_id % 4001 AS run_id, CASE WHEN event_id % 4001 % 8 > 0 THEN 'agent' || (event_id % 4001 % 8) END AS agent, event_id AS seq,
    CASE WHEN event_type = 'purchase' THEN 'merged' WHEN event_type = 'signup' THEN 'shipped_no_regress' WHEN event_type = 'error' AND value > 45 THEN 'reverted' WHEN event_type = 'error' AND value > 40 THEN 'incident' END AS outcome FROM events),
    l AS (SELECT * FROM lb WHERE outcome IS NOT NULL)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as check results of verdicts (one for each user and day)."""
    e = _events(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in evidence.CHECK_KINDS])
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 60, "error").otherwise("fail")).when((F.col("event_type") == "click") & (F.col("value") > 30), "flaky").otherwise("pass")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    return e.select(F.concat_ws("-", F.col("user_id"), day).alias("verdict_id"), F.col("event_id").alias("seq"), F.concat(F.lit("check"), F.col("event_id") % 9).alias("name"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), status.alias("status"), (F.col("event_id") % 3 == 0).alias("required"))


_CHECKS = """k AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS verdict_id, event_id AS seq, 'check' || (event_id % 9) AS name,
    ['test', 'typecheck', 'build', 'lint', 'property', 'mutation', 'contamination'][event_id % 7 + 1] AS kind, CAST(event_id % 7 + 1 AS INTEGER) AS kind_rank,
    CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 'error' ELSE 'fail' END WHEN event_type = 'click' AND value > 30 THEN 'flaky' ELSE 'pass' END AS status, event_id % 3 = 0 AS required FROM events)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run tapes: the run is the user, seq its place by time."""
    e = _events(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("at_ms", "event_id")) - 1
    body = F.to_json(F.struct(F.col("event_id"), F.col("event_type"), F.col("props")))
    return e.select(F.col("user_id").alias("run_id"), seq.cast("long").alias("seq"), "event_type", "value", "at_ms", F.sha2(body, 256).alias("event_hash"), body.alias("body"))


_TAPE = """ev AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq, event_id, event_type, value, epoch_us(ts) // 1000 AS at_ms,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', chr(92) || '"') || '"}' AS body FROM events),
    t AS (SELECT *, sha256(body) AS event_hash FROM ev)"""
_SEALED = "h AS (SELECT run_id, seq, event_hash, sha256('' || event_hash) AS chained_hash FROM t WHERE seq = 0 UNION ALL SELECT t.run_id, t.seq, t.event_hash, sha256(h.chained_hash || t.event_hash) FROM h JOIN t ON t.run_id = h.run_id AND t.seq = h.seq + 1)"


def ledger(spark: SparkSession, sf_dir: str, tamper: bool = False) -> DataFrame:
    """Tapes sealed as ledgers; with ``tamper`` some logs have a changed body, a gap or a broken link."""
    from fernlode.functions.hashing import ledger_identity

    own = tape(spark, sf_dir)
    sealed = chains.seal(own.select("run_id", "seq", ledger_identity(F.col("seq"), F.col("body")).alias("event_hash")))
    rows = sealed.join(own.select("run_id", "seq", "body"), ["run_id", "seq"])
    before = F.lag("chained_hash", 1, "").over(Window.partitionBy("run_id").orderBy("seq"))
    out = rows.select(F.col("run_id").alias("log_id"), F.col("seq").alias("position"), "seq", F.col("body").alias("kind_json"), before.alias("prev_hash"), F.col("chained_hash").alias("record_hash"))
    if tamper:
        hit = lambda k: (F.col("log_id") % 5 == k) & (F.col("position") == 3 + F.col("log_id") % 11)
        out = out.withColumns({"kind_json": F.when(hit(1), F.concat("kind_json", F.lit(" "))).otherwise(F.col("kind_json")), "seq": F.when(hit(2), F.col("seq") + 1).otherwise(F.col("seq")), "prev_hash": F.when(hit(3), F.lit("0")).otherwise(F.col("prev_hash"))})
    return out


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).select("run_id", "seq", F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("long")).alias("cost"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.round(F.col("value") * 10).cast("long")
    return tape(spark, sf_dir).select("run_id", F.concat(F.lit("m"), F.col("seq") % 4).alias("model"), n.alias("input_tokens"), (n * 2).alias("output_tokens"), (n + 1).alias("cache_read_tokens"), F.lit(3).cast("long").alias("cache_creation_tokens"))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m0", 3, 15, 1, 4), ("m1", 1, 5, 0, 1), ("m2", 15, 75, 2, 19)], "model string, input_tokens_price long, output_tokens_price long, cache_read_tokens_price long, cache_creation_tokens_price long")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.floor(F.col("event_id") / 5).cast("long").alias("join_id"), (F.col("event_id") % 5).alias("idx"), F.col("event_type").isin("purchase", "signup", "click").alias("ok"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = checks(spark, sf_dir)
    verdicts = evidence.receipt_verdict(k.filter("required")).select(F.col("verdict_id").alias("receipt_id"), "verdict")
    required = verdicts.select("receipt_id", F.explode(F.array(F.lit("check0"), F.lit("check3"))).alias("name"))
    states = evidence.required_checks(k, required)
    specs = verdicts.select("receipt_id", F.lit("a").alias("checkspec_hash"), F.when(F.col("receipt_id").like("%7"), "b").otherwise("a").alias("expected_checkspec_hash"))
    return evidence.merge_gate(verdicts, states, specs)


def _tier(n: Column) -> Column:
    """The n-th isolation tier (from 1), the strictest one for every larger number."""
    return F.element_at(F.array(*[F.lit(t) for t in evidence.ISOLATION_TIERS]), F.least(n, F.lit(len(evidence.ISOLATION_TIERS))))


_GATE = f"""{_CHECKS}, v AS (SELECT verdict_id AS receipt_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN NOT bool_and(status = 'pass') THEN 'failed' ELSE 'passed' END AS verdict FROM k WHERE required GROUP BY 1),
    q AS (SELECT receipt_id, unnest(['check0', 'check3']) AS name FROM v), f AS (SELECT verdict_id AS receipt_id, name, arg_min(status, seq) AS status FROM k GROUP BY ALL),
    s AS (SELECT q.receipt_id, count(*) FILTER (WHERE f.status IS NULL) AS missing, count(*) FILTER (WHERE f.status <> 'pass') AS not_passed FROM q LEFT JOIN f USING (receipt_id, name) GROUP BY 1),
    g AS (SELECT receipt_id, CASE WHEN verdict = 'failed' THEN 'failure' WHEN verdict = 'error' THEN 'neutral' WHEN receipt_id LIKE '%7' THEN 'neutral' WHEN not_passed > 0 THEN 'failure' WHEN missing > 0 THEN 'neutral' ELSE 'success' END AS conclusion FROM v JOIN s USING (receipt_id))"""

QUERIES = {
    "outcome_summary": lambda s, d: evidence.outcome_summary(s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 4001).alias("run_id")).distinct(), labels(s, d)),
    "outcome_calibration": lambda s, d: evidence.outcome_calibration(labels(s, d)),
    "outcome_query": lambda s, d: evidence.outcome_query(labels(s, d), "agent3", "reverted"),
    "flaky_rates": lambda s, d: evidence.flaky_rates(checks(s, d)),
    "verdict_status": lambda s, d: evidence.verdict_status(checks(s, d)),
    "receipt_verdict": lambda s, d: evidence.receipt_verdict(checks(s, d)),
    "rerun_fold": lambda s, d: evidence.rerun_fold(checks(s, d).select(F.concat_ws("/", "verdict_id", "name").alias("check_id"), (F.col("status") == "pass").alias("passed"), (F.col("status") == "error").alias("launch_error"))),
    "required_checks": lambda s, d: evidence.required_checks(checks(s, d), checks(s, d).select(F.col("verdict_id").alias("receipt_id"), F.lit("check4").alias("name")).distinct()),
    "merge_gate": _gate,
    "isolation_floor": lambda s, d: evidence.isolation_floor(_gate(s, d).withColumn("isolation_tier", _tier(F.char_length("receipt_id") - 8)), "contained"),
    "run_summary": lambda s, d: evidence.run_summary(tape(s, d).select("run_id", F.concat(F.lit("a"), F.col("run_id") % 3).alias("agent"), F.when(F.col("event_type") == "purchase", "run_finished").otherwise("output").alias("kind"), "at_ms")),
    "budget_fold": lambda s, d: evidence.budget_fold(_usage(s, d), 30000),
    "cost_estimate": lambda s, d: evidence.cost_estimate(_tokens(s, d), _prices(s)),
    "branch_join_all": lambda s, d: evidence.branch_join(_branches(s, d), "all"),
    "branch_join_first_ok": lambda s, d: evidence.branch_join(_branches(s, d), "first_ok"),
    "branch_join_quorum": lambda s, d: evidence.branch_join(_branches(s, d), "quorum", 3),
    "latest_per_node": lambda s, d: evidence.latest_per_node(tape(s, d).select((F.col("run_id") % 40).alias("node_id"), (F.col("run_id") * 100000 + F.col("seq")).alias("seq"), F.col("event_hash").alias("text"))),
    "compact_history": lambda s, d: evidence.compact_history(_messages(s, d), 1200, 100, 1, 2),
    "largest_message": lambda s, d: evidence.largest_message(_messages(s, d)),
    "ledger_facets": lambda s, d: evidence.ledger_query(tape(s, d).select("run_id", "seq", F.col("event_type").alias("kind"), F.concat(F.lit("a"), F.col("run_id") % 3).alias("agent")), None, record_kind="error", agent="a1"),
    "seal_chain": lambda s, d: chains.seal(tape(s, d)),
    "chain_roots": lambda s, d: chains.chain_roots(chains.seal(tape(s, d))),
    "verify_ledger": lambda s, d: chains.verify_ledger(ledger(s, d)).drop("head_hash"),
    "verify_tampered_ledger": lambda s, d: chains.verify_ledger(ledger(s, d, True)).drop("head_hash"),
    "replay_verify": lambda s, d: chains.replay_verify(tape(s, d), chains.seal(tape(s, d)).withColumn("event_hash", F.when((F.col("run_id") % 3 == 0) & (F.col("seq") == 5), "x").otherwise(F.col("event_hash"))), chains.chain_roots(chains.seal(tape(s, d))).select("run_id", "root_hash")),
}

ORACLE_SQL = {
    "outcome_summary": f"""WITH {_LABELS} SELECT (SELECT count(DISTINCT event_id % 4001) FROM events) AS total_runs, count(DISTINCT run_id) AS labeled_runs, count(*) FILTER (WHERE outcome = 'merged') AS merged,
        count(*) FILTER (WHERE outcome = 'shipped_no_regress') AS shipped_no_regress, count(*) FILTER (WHERE outcome = 'reverted') AS reverted, count(*) FILTER (WHERE outcome = 'incident') AS incident FROM l""",
    "outcome_calibration": f"""WITH {_LABELS}, r AS (SELECT run_id, coalesce(max(agent), 'unattributed') AS agent, bool_or(outcome IN ('merged', 'shipped_no_regress')) AS pos, bool_or(outcome IN ('reverted', 'incident')) AS neg FROM l GROUP BY 1),
        c AS (SELECT coalesce(agent, '*') AS agent, count(*) AS labeled_runs, count(*) FILTER (WHERE pos AND NOT neg) AS shipped, count(*) FILTER (WHERE neg) AS regressed, count(*) FILTER (WHERE pos AND neg) AS passed_and_regressed FROM r GROUP BY GROUPING SETS ((agent), ()))
        SELECT *, CAST(shipped * 1000 // labeled_runs AS BIGINT) AS ship_permille FROM c""",
    "outcome_query": f"WITH {_LABELS} SELECT run_id, max(agent) AS agent, count(*) AS n_labels FROM l WHERE agent = 'agent3' GROUP BY 1 HAVING bool_or(outcome = 'reverted')",
    "flaky_rates": f"WITH {_CHECKS} SELECT name, kind, count(*) AS runs, count(*) FILTER (WHERE status = 'flaky') AS flaky, count(*) FILTER (WHERE status = 'fail') AS fail, CAST(count(*) FILTER (WHERE status = 'flaky') * 1000 // count(*) AS BIGINT) AS flaky_permille, any_value(kind_rank) AS kind_rank FROM k GROUP BY name, kind",
    "verdict_status": f"WITH {_CHECKS} SELECT verdict_id, CASE WHEN count(*) FILTER (WHERE required) = 0 THEN 'inconclusive' WHEN bool_or(required AND status = 'error') THEN 'error' WHEN bool_or(required AND status = 'fail') THEN 'failed' WHEN bool_or(required AND status = 'flaky') THEN 'inconclusive' ELSE 'passed' END AS status FROM k GROUP BY 1",
    "receipt_verdict": f"WITH {_CHECKS} SELECT verdict_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN NOT bool_and(status = 'pass') THEN 'failed' ELSE 'passed' END AS verdict FROM k GROUP BY 1",
    "rerun_fold": f"WITH {_CHECKS} SELECT verdict_id || '/' || name AS check_id, count(*) AS runs, count(*) FILTER (WHERE status = 'pass') AS passed, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status = 'pass') THEN 'pass' WHEN NOT bool_or(status = 'pass') THEN 'fail' ELSE 'flaky' END AS status FROM k GROUP BY 1",
    "required_checks": f"WITH {_CHECKS}, v AS (SELECT DISTINCT verdict_id FROM k), f AS (SELECT verdict_id, arg_min(status, seq) AS status FROM k WHERE name = 'check4' GROUP BY 1) SELECT verdict_id AS receipt_id, 'check4' AS name, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'pass' THEN 'passed' ELSE 'present_not_passed' END AS state FROM v LEFT JOIN f USING (verdict_id)",
    "merge_gate": f"WITH {_GATE} SELECT receipt_id, conclusion, CAST(CASE conclusion WHEN 'success' THEN 0 WHEN 'failure' THEN 1 ELSE 2 END AS INTEGER) AS exit_code FROM g",
    "isolation_floor": f"WITH {_GATE} SELECT receipt_id, CASE WHEN length(receipt_id) - 8 < 3 AND conclusion = 'success' THEN 'neutral' ELSE conclusion END AS conclusion, length(receipt_id) - 8 < 3 AS below_floor FROM g",
    "run_summary": f"WITH {_TAPE} SELECT run_id, 'a' || (run_id % 3) AS agent, count(*) AS event_count, min(at_ms) AS started_at_ms, bool_or(event_type = 'purchase') AS finished FROM t GROUP BY run_id",
    "budget_fold": f"""WITH {_TAPE}, u AS (SELECT run_id, seq, CAST(sum(CASE WHEN event_type = 'view' THEN 30000 ELSE CAST(round(value * 100) AS BIGINT) END) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS spent FROM t)
        SELECT run_id, seq, spent, spent > 30000 AS exhausted, spent >= 24000 AND coalesce(lag(spent) OVER (PARTITION BY run_id ORDER BY seq), 0) < 24000 AS warning FROM u""",
    "cost_estimate": f"""WITH {_TAPE}, n AS (SELECT run_id, seq % 4 AS m, CAST(round(value * 10) AS BIGINT) AS n FROM t)
        SELECT run_id, 'm' || m AS model, CAST(sum(n) AS BIGINT) AS input_tokens, CAST(sum(2 * n) AS BIGINT) AS output_tokens, CAST(sum(n + 1) AS BIGINT) AS cache_read_tokens, CAST(3 * count(*) AS BIGINT) AS cache_creation_tokens,
               CAST(sum(CASE m WHEN 0 THEN 3 * n + 30 * n + (n + 1) + 12 WHEN 1 THEN n + 10 * n + 3 WHEN 2 THEN 15 * n + 150 * n + 2 * (n + 1) + 57 ELSE 0 END) AS BIGINT) AS cost_micro_usd FROM n GROUP BY run_id, m""",
    **{
        f"branch_join_{mode}": f"""WITH b AS (SELECT event_id // 5 AS join_id, event_id % 5 AS idx, event_type IN ('purchase', 'signup', 'click') AS ok FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY join_id ORDER BY ok DESC, idx) AS k FROM b)
        SELECT join_id, {success} AS success, count(*) FILTER (WHERE {keep}) AS kept, min(idx) FILTER (WHERE {keep}) AS first_kept, count(*) FILTER (WHERE ok) AS votes FROM r GROUP BY 1"""
        for mode, keep, success in (("all", "true", "bool_and(ok)"), ("first_ok", "ok AND k = 1", "bool_or(ok)"), ("quorum", "ok AND k <= 3", "count(*) FILTER (WHERE ok) >= 3"))
    },
    "latest_per_node": f"WITH {_TAPE}, n AS (SELECT run_id % 40 AS node_id, run_id * 100000 + seq AS seq, event_hash AS text FROM t) SELECT node_id, arg_max(text, seq) AS text, max(seq) AS seq FROM n GROUP BY 1",
    "compact_history": """WITH m AS (SELECT conv_id, turn, role, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations),
        e AS (SELECT *, a <= 1 OR z <= 2 AS edge FROM m), s AS (SELECT *, sum(CASE WHEN edge THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed, sum(CASE WHEN edge THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM e)
        SELECT conv_id, turn, role, tokens, edge OR fixed + running <= 740 AS kept FROM s""",
    "largest_message": "SELECT conv_id, arg_max(turn, length(coalesce(text, '')) * 100000 + turn) AS turn, CAST(max(length(coalesce(text, ''))) AS INTEGER) AS chars FROM conversations GROUP BY 1",
    "ledger_facets": f"WITH {_TAPE} SELECT run_id, seq, event_type AS kind, 'a' || (run_id % 3) AS agent FROM t WHERE event_type = 'error' AND run_id % 3 = 1",
    "seal_chain": f"WITH RECURSIVE {_TAPE}, {_SEALED} SELECT * FROM h",
    "chain_roots": f"WITH RECURSIVE {_TAPE}, {_SEALED} SELECT run_id, arg_max(chained_hash, seq) AS root_hash, count(*) AS events FROM h GROUP BY 1",
    "verify_ledger": "SELECT user_id AS log_id, count(*) AS records, true AS ok, CAST(NULL AS VARCHAR) AS failure, CAST(NULL AS BIGINT) AS failed_at FROM events GROUP BY 1",
    "verify_tampered_ledger": """WITH c AS (SELECT user_id AS log_id, count(*) AS records FROM events GROUP BY 1), f AS (SELECT *, CASE log_id % 5 WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'seq_gap' WHEN 3 THEN 'prev_mismatch' END AS failure, 3 + log_id % 11 AS place FROM c)
        SELECT log_id, records, failure IS NULL OR place >= records AS ok, CASE WHEN place < records THEN failure END AS failure, CASE WHEN failure IS NOT NULL AND place < records THEN place END AS failed_at FROM f""",
    "replay_verify": "SELECT user_id AS run_id, user_id % 3 <> 0 OR count(*) <= 5 AS verified, CASE WHEN user_id % 3 = 0 AND count(*) > 5 THEN CAST(5 AS BIGINT) END AS diverged_at_seq FROM events GROUP BY 1",
}
