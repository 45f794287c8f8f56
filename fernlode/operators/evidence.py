"""Evidence analytics: outcomes, calibration, verdicts, gates, budgets and branch folds.

Tables (long form, so a run's labels or checks are never gathered in one row):
labels(run_id, agent, seq, outcome, source), checks(verdict_id, seq, name, kind, status, required, runs, passed),
usage(run_id, seq, model, four token counts), branches(join_id, idx, ok, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
POSITIVE, NEGATIVE = ("merged", "shipped_no_regress"), ("reverted", "incident")
CHECK_KINDS = ("test", "typecheck", "build", "lint", "property", "mutation", "contamination")
ISOLATION_TIERS = ("unconfined", "best_effort", "contained", "hermetic")
UNATTRIBUTED = "unattributed"
WARN_AT = 0.8


def kind_rank(kind: Column) -> Column:
    """Place of a check kind in its declared (not alphabetical) order."""
    return F.array_position(F.array(*[F.lit(k) for k in CHECK_KINDS]), kind).cast("int")


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in ISOLATION_TIERS]), tier).cast("int")


def _permille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / F.when(whole > 0, whole))).otherwise(0).cast("long")


def outcome_summary(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs, runs with a label, and labels of each outcome, as one row."""
    total = runs.agg(F.count("*").alias("total_runs"))
    counted = labels.agg(F.count_distinct("run_id").alias("labeled_runs"), *[F.count_if(F.col("outcome") == o).alias(o) for o in (*POSITIVE, *NEGATIVE)])
    return total.crossJoin(counted)


def outcome_calibration(labels: DataFrame) -> DataFrame:
    """Per agent and overall ('*'): labelled runs, shipped, regressed, both, and the shipped share in permille."""
    runs = labels.groupBy("run_id").agg(F.coalesce(F.max("agent"), F.lit(UNATTRIBUTED)).alias("agent"), F.max(F.col("outcome").isin(*POSITIVE)).alias("pos"), F.max(F.col("outcome").isin(*NEGATIVE)).alias("neg"))
    counts = [F.count("*").alias("labeled_runs"), F.count_if(F.col("pos") & ~F.col("neg")).alias("shipped"), F.count_if("neg").alias("regressed"), F.count_if(F.col("pos") & F.col("neg")).alias("passed_and_regressed")]
    # The overall row is a second grouping set of the same pass, not a second scan.
    both = runs.withColumn("agent", F.explode(F.array("agent", F.lit("*")))).groupBy("agent").agg(*counts)
    return both.withColumn("ship_permille", _permille(F.col("shipped"), F.col("labeled_runs")))


def flaky_rates(checks: DataFrame) -> DataFrame:
    """Per check name and kind: runs, flaky, failed and the flaky share in permille."""
    rates = checks.groupBy("name", "kind").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "flaky").alias("flaky"), F.count_if(F.col("status") == "fail").alias("fail"))
    return rates.withColumns({"flaky_permille": _permille(F.col("flaky"), F.col("runs")), "kind_rank": kind_rank(F.col("kind"))})


def verdict_status(checks: DataFrame) -> DataFrame:
    """Status over required checks: none inconclusive, else error over failed over inconclusive (flaky) over passed."""
    severity = F.when(F.col("status") == "error", 3).when(F.col("status") == "fail", 2).when(F.col("status") == "flaky", 1).otherwise(0)
    worst = checks.groupBy("verdict_id").agg(F.max(F.when(F.coalesce("required", F.lit(False)), severity)).alias("_w"))
    status = F.when(F.col("_w") == 3, "error").when(F.col("_w") == 2, "failed").when(F.col("_w") == 0, "passed").otherwise("inconclusive")
    return worst.select("verdict_id", status.alias("status"))


def receipt_verdict(checks: DataFrame) -> DataFrame:
    """Over all checks: any error is error, any not passed is failed, else passed (no checks: inconclusive)."""
    return checks.groupBy("verdict_id").agg(F.count("status").alias("_n"), F.max(F.col("status") == "error").alias("_e"), F.min(F.col("status") == "pass").alias("_p")).select(
        "verdict_id", F.when(F.col("_n") == 0, "inconclusive").when(F.col("_e"), "error").when(~F.col("_p"), "failed").otherwise("passed").alias("verdict"))


def rerun_fold(attempts: DataFrame) -> DataFrame:
    """attempts(check_id, passed, launch_error): no attempt or a launch error is error, all pass, none fail, mixed flaky."""
    folded = attempts.groupBy("check_id").agg(F.count("passed").alias("runs"), F.count_if("passed").alias("passed"), F.max(F.coalesce("launch_error", F.lit(False))).alias("_e"))
    status = F.when(F.col("_e") | (F.col("runs") == 0), "error").when(F.col("passed") == F.col("runs"), "pass").when(F.col("passed") == 0, "fail").otherwise("flaky")
    return folded.select("check_id", "runs", "passed", status.alias("status"))


def required_checks(receipt_checks: DataFrame, required: DataFrame) -> DataFrame:
    """required(receipt_id, name) against the first check of that name: missing, present_not_passed or passed."""
    first = receipt_checks.groupBy(F.col("verdict_id").alias("receipt_id"), "name").agg(F.min_by("status", "seq").alias("status"))
    joined = required.join(first, ["receipt_id", "name"], "left")
    return joined.select("receipt_id", "name", F.when(F.col("status").isNull(), "missing").when(F.col("status") == "pass", "passed").otherwise("present_not_passed").alias("state"))


def merge_gate(verdicts: DataFrame, required_states: DataFrame, checkspecs: DataFrame) -> DataFrame:
    """Conclusion and exit code; the merge bar may only downgrade.

    verdicts(receipt_id, verdict), checkspecs(receipt_id, checkspec_hash, expected_checkspec_hash).
    """
    bar = required_states.groupBy("receipt_id").agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "present_not_passed").alias("not_passed"))
    joined = verdicts.join(bar, "receipt_id", "left").join(checkspecs, "receipt_id", "left")
    base = F.when(F.col("verdict") == "passed", "success").when(F.col("verdict") == "failed", "failure").otherwise("neutral")
    mismatch = F.col("expected_checkspec_hash").isNotNull() & ~F.col("checkspec_hash").eqNullSafe(F.col("expected_checkspec_hash"))
    final = F.when(base != "success", base).when(mismatch, "neutral").when(F.coalesce("not_passed", F.lit(0)) > 0, "failure").when(F.coalesce("missing", F.lit(0)) > 0, "neutral").otherwise(base)
    return joined.select("receipt_id", final.alias("conclusion")).withColumn("exit_code", F.when(F.col("conclusion") == "success", 0).when(F.col("conclusion") == "failure", 1).otherwise(2))


def isolation_floor(outcomes: DataFrame, required_tier: str) -> DataFrame:
    """outcomes(receipt_id, conclusion, isolation_tier): success below the required tier becomes neutral."""
    low = F.coalesce(tier_rank(F.col("isolation_tier")), F.lit(0)) < ISOLATION_TIERS.index(required_tier) + 1
    return outcomes.select("receipt_id", F.when(low & (F.col("conclusion") == "success"), "neutral").otherwise(F.col("conclusion")).alias("conclusion"), low.alias("below_floor"))


def ledger_query(ledger: DataFrame, limit: int | None = 200, **facets: str | None) -> DataFrame:
    """Records for which every given facet equals; a facet that a kind lacks is null there and does not match. Newest first."""
    rows = ledger
    for name, value in facets.items():
        if value is not None:
            rows = rows.filter(F.col("kind" if name == "record_kind" else name) == value)
    return rows if limit is None else rows.orderBy(F.desc("seq")).limit(limit)


def outcome_query(labels: DataFrame, agent: str | None = None, outcome: str | None = None) -> DataFrame:
    """Runs of the agent that have any label with the outcome."""
    rows = labels if agent is None else labels.filter(F.col("agent") == agent)
    runs = rows.groupBy("run_id").agg(F.max("agent").alias("agent"), F.count("*").alias("n_labels"), F.max(F.col("outcome") == outcome).alias("_any") if outcome else F.lit(True).alias("_any"))
    return runs.filter("_any").drop("_any")


def verdict_query(verdicts: DataFrame, run_id: str | None = None) -> DataFrame:
    """Sealed verdicts, of one run if it is given; newest first by the caller's order."""
    return verdicts if run_id is None else verdicts.filter(F.col("run_id") == run_id)


def run_summary(tape: DataFrame) -> DataFrame:
    """Per run: agent, events, first time, finished; newest first by the caller's order."""
    return tape.groupBy("run_id").agg(F.max("agent").alias("agent"), F.count("*").alias("event_count"), F.min("at_ms").alias("started_at_ms"), F.max(F.col("kind") == "run_finished").alias("finished"))


def run_lineage(ledger: DataFrame) -> DataFrame:
    """Verdicts and receipts with the run they belong to (by run root hash, and by verdict id)."""
    runs = ledger.filter("kind = 'run_recorded'").select("run_root_hash", "run_id")
    verdicts = ledger.filter("kind = 'verdict'").select("verdict_id", "run_root_hash").join(runs, "run_root_hash")
    receipts = ledger.filter("kind = 'receipt_issued'").select("receipt_id", "verdict_id")
    return verdicts.join(receipts, "verdict_id", "left").select("run_id", "verdict_id", "receipt_id")


def receipt_for_run(receipts: DataFrame, run_id: str) -> DataFrame:
    return receipts.filter(F.col("statement.provenance.run_id") == run_id).orderBy("receipt_id").limit(1)


def merge_live(live: DataFrame, persisted: DataFrame, key: str = "id") -> DataFrame:
    """Live rows win by id; persisted rows fill the rest."""
    return live.unionByName(persisted.join(live.select(key), key, "left_anti").select(*live.columns))


def budget_fold(usage: DataFrame, limit: int, group: str = "run_id") -> DataFrame:
    """Running spend; exhausted once over the limit and from then on; one warning at 80 %. Unreported usage is charged the whole limit."""
    order = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce("cost", F.lit(limit)).cast("long")).over(order)
    rows = usage.select(group, "seq", spent.alias("spent"))
    over = F.max((F.col("spent") > limit).cast("int")).over(order) == 1
    near = F.col("spent") >= limit * WARN_AT
    first = F.sum(near.cast("int")).over(order) == 1
    return rows.select(group, "seq", "spent", over.alias("exhausted"), (near & first).alias("warning"))


def cost_estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Micro-dollars from prices per million tokens of four classes; an unknown model costs 0."""
    classes = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    joined = usage.join(F.broadcast(prices), "model", "left")  # a price list
    cost = sum((F.col(c) * F.coalesce(F.col(f"{c}_price"), F.lit(0)) for c in classes), F.lit(0))
    return joined.groupBy("run_id", "model").agg(*[F.sum(c).alias(c) for c in classes], F.sum(cost).alias("cost_micro_usd"))


def branch_join(branches: DataFrame, mode: str, quorum: int = 1) -> DataFrame:
    """all: every branch ok; first_ok: the first ok in declared order; quorum: the first n ok. Kept branches and success for each join."""
    rank = F.row_number().over(Window.partitionBy("join_id").orderBy(F.desc("ok"), "idx"))
    rows = branches.withColumn("_r", rank)
    keep = {"all": F.lit(True), "first_ok": F.col("ok") & (F.col("_r") == 1), "quorum": F.col("ok") & (F.col("_r") <= quorum)}[mode]
    ok = {"all": F.min("ok"), "first_ok": F.max("ok"), "quorum": F.count_if("ok") >= quorum}[mode]
    return rows.groupBy("join_id").agg(ok.alias("success"), F.count_if(keep).alias("kept"), F.min(F.when(keep, F.col("idx"))).alias("first_kept"), F.count_if("ok").alias("votes"))


def latest_per_node(tape: DataFrame) -> DataFrame:
    """Last result text of each node."""
    return tape.groupBy("node_id").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def churn(numstat: DataFrame) -> DataFrame:
    """Insertions plus deletions (binary: 0) of each path."""
    return numstat.groupBy("path").agg(F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn"))


def compact_history(messages: DataFrame, window: int, reserve: int = 0, head: int = 2, tail: int = 8) -> DataFrame:
    """messages(conv_id, turn, role, text): which bodies are kept.

    The first ``head`` and last ``tail`` messages stay; of the rest, newest first, those stay whose running token
    estimate fits the budget (70 % of the window less the reserve, a quarter of the window at least).
    """
    budget = max(window * 7 // 10 - reserve, window // 4)
    by = Window.partitionBy("conv_id")
    tokens = F.ceil(F.char_length("text") / 4).cast("long")
    rows = messages.select("conv_id", "turn", "role", tokens.alias("tokens"), F.row_number().over(by.orderBy("turn")).alias("_a"), F.row_number().over(by.orderBy(F.desc("turn"))).alias("_z"))
    edge = (F.col("_a") <= head) | (F.col("_z") <= tail)
    fixed = F.sum(F.when(edge, F.col("tokens")).otherwise(0)).over(by)
    running = F.sum(F.when(edge, 0).otherwise(F.col("tokens"))).over(by.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kept", edge | (fixed + running <= budget)).select("conv_id", "turn", "role", "tokens", "kept")


def largest_message(messages: DataFrame) -> DataFrame:
    """The message of each conversation to stub on overflow: the largest, the last of equals."""
    return messages.groupBy("conv_id").agg(F.max(F.struct(F.char_length("text").alias("chars"), F.col("turn"))).alias("m")).select("conv_id", "m.turn", "m.chars")
