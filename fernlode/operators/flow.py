"""Flows as tables: what a strategy runs, phase by phase, and what comes next given what has been started and finished.

A strategy is compiled into phases of nodes.  A phase is settled when all its nodes have results, and falls short if
fewer than its least number of them went well; then the flow ends.  All flows take their step in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("single", "parallel", "pipeline", "map_reduce", "vote", "debate", "hierarchical")
_NODE = "struct<phase: int, node: string, min_ok: int>"


def _nodes(phase: Column, name: str, n: Column, least: Column) -> Column:
    """n nodes of one phase, named by the phase's kind and their place."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(phase.cast("int").alias("phase"), F.concat(F.lit(name), k.cast("string")).alias("node"), least.cast("int").alias("min_ok")))


def compile_flows(flows: DataFrame) -> DataFrame:
    """flows(flow_id, strategy, n, rounds, k) as (flow_id, phase, node, min_ok).

    parallel needs one of n nodes; pipeline n nodes, one after the other; map_reduce n nodes and a reducer; vote n candidates, of which k must go
    well, and a judge; debate n sides for some rounds and a judge; hierarchical a planner, n workers and a summary. A flow
    with nothing to map, vote on or debate has no nodes.
    """
    n, rounds, k, one, none = F.col("n"), F.col("rounds"), F.col("k"), F.lit(1), F.lit(0)
    turns = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    phases = {
        "single": _nodes(none, "step", one, one),
        "parallel": _nodes(none, "branch", n, one),
        "pipeline": F.transform(steps, lambda s: F.struct(s.cast("int").alias("phase"), F.concat(F.lit("step"), s.cast("string")).alias("node"), one.alias("min_ok"))),
        "map_reduce": F.concat(_nodes(none, "map", n, none), _nodes(one, "reduce", F.least(n, one), one)),
        "vote": F.concat(_nodes(none, "candidate", n, k), _nodes(one, "judge", F.least(n, one), one)),
        "debate": F.concat(F.flatten(F.transform(turns, lambda t: F.transform(steps, lambda s: F.struct(t.cast("int").alias("phase"), F.concat(F.lit("turn"), t.cast("string"), F.lit("-"), s.cast("string")).alias("node"), none.alias("min_ok"))))), _nodes(rounds, "judge", F.least(n, rounds, one), one)),
        "hierarchical": F.concat(_nodes(none, "plan", one, one), _nodes(one, "worker", n, none), _nodes(F.lit(2), "summary", one, one)),
    }
    nodes = F.lit(None).cast(f"array<{_NODE}>")
    for strategy, own in phases.items():
        nodes = F.when(F.col("strategy") == strategy, own.cast(f"array<{_NODE}>")).otherwise(nodes)
    return flows.select("flow_id", F.inline(nodes))


def next_actions(nodes: DataFrame, started: DataFrame, results: DataFrame) -> DataFrame:
    """(flow_id, action, node, ok): nodes to start now, or the flow's finish; flows that wait have no row.

    started(flow_id, node), results(flow_id, node, ok): of several results of a node the flow takes it as well if one went well.
    """
    key = ["flow_id", "node"]
    known = results.groupBy(*key).agg(F.max("ok").alias("_ok"))
    begun = started.select(*key).unionByName(results.select(*key)).groupBy(*key).agg(F.lit(True).alias("_begun"))
    rows = nodes.join(known, key, "left").join(begun, key, "left")
    phases = rows.groupBy("flow_id", "phase", "min_ok").agg((F.count("_ok") == F.count("*")).alias("settled"), (F.count_if("_ok") < F.col("min_ok")).alias("low"))
    open_ = F.when(~F.col("settled") | F.col("low"), F.struct("phase", (F.col("settled") & F.col("low")).alias("short")))
    front = phases.groupBy("flow_id").agg(F.min(open_).alias("front"))
    ends = front.filter(F.col("front").isNull() | F.col("front.short")).select("flow_id", F.lit("finish").alias("action"), F.lit(None).cast("string").alias("node"), F.col("front").isNull().alias("ok"))
    going = front.filter(~F.col("front.short")).select("flow_id", F.col("front.phase").alias("phase"))
    starts = rows.join(going, ["flow_id", "phase"]).filter(F.col("_begun").isNull()).select("flow_id", F.lit("start").alias("action"), "node", F.lit(None).cast("boolean").alias("ok"))
    return starts.unionByName(ends)
