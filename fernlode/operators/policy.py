"""Policy: tiers of tools, rules by pattern, content addresses of policies and decisions, and remembered facts."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlode.functions.hashing import hash_canonical, sha256_json

TIERS = ("read_only", "edit", "exec")
# Tools that only read (or write their own notes), and tools that edit; every other tool is exec.
READ_ONLY_TOOLS = ("file_search", "read_file", "get_code_structure", "get_repo_map", "goto_definition", "find_references", "call_hierarchy", "ast_search", "build_context", "workspace_context", "git", "list_agents", "update_checkpoint", "remember")
EDIT_TOOLS = ("edit", "write", "delete", "move", "ast_edit", "manage_selection", "manage_workspaces")
# The heading of the block of facts, and how many characters the block may have.
MEMORY_HEADER = "## Project memory (durable facts learned in past sessions)"
MEMORY_CHARS = 2000


def tool_tier(name: Column) -> Column:
    """Tier of a tool; what is not known is exec."""
    return F.when(name.isin(*READ_ONLY_TOOLS), "read_only").when(name.isin(*EDIT_TOOLS), "edit").otherwise("exec")


def allowed_without_asking(name: Column, highest: str) -> Column:
    """Whether a tool's tier is at most the highest one that a mode lets through."""
    return tool_tier(name).isin(*TIERS[: TIERS.index(highest) + 1])


def pattern_matches(text: Column, pattern: str) -> Column:
    """'*' stands for any run of characters, everything else for itself."""
    return text.rlike("(?s)\\A" + ".*".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", part) for part in pattern.split("*")) + "\\z")


def decide(calls: DataFrame, rules: list[tuple[str, str]], otherwise: str = "ask", column: str = "tool") -> DataFrame:
    """calls with decision: that of the first rule (pattern, decision) whose pattern matches the tool."""
    decision = F.lit(otherwise)
    for pattern, own in reversed(rules):
        decision = F.when(pattern_matches(F.col(column), pattern), own).otherwise(decision)
    return calls.withColumn("decision", decision)


def seal_policy(policy: dict) -> dict:
    """The policy with its version: SHA-256 of its JSON in declared order, the version itself empty."""
    body = {**policy, "policy_version": ""}
    return {**body, "policy_version": hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}


def decision_hash(decision: Column) -> Column:
    """Content address of a decision record (a struct, fields in declared order)."""
    return sha256_json(decision)


@F.pandas_udf(T.StringType())
def json_hash(value: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys: of the arguments of a call, or of a specification of checks."""
    return value.map(lambda v: None if v is None else hash_canonical(json.loads(v)))


def remember(facts: DataFrame, key: str = "project", cap: int = MEMORY_CHARS) -> DataFrame:
    """facts(key, seq, fact) as (key, place, fact): trimmed, each once, in order, as far as the block stays within the cap.

    A fact that would go over the cap is left out; a shorter one after it may still fit.
    """
    own = facts.select(key, "seq", F.trim("fact").alias("fact")).filter("fact <> ''").groupBy(key, "fact").agg(F.min("seq").alias("seq"))
    listed = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "fact"))).alias("_f"))
    start = F.struct(F.lit(len(MEMORY_HEADER)).alias("size"), F.array().cast("array<string>").alias("kept"))

    def add(state: Column, x: Column) -> Column:
        size = state["size"] + F.char_length(x["fact"]) + 3  # a line break, a dash and a space
        return F.when(size > cap, state).otherwise(F.struct(size.alias("size"), F.concat(state["kept"], F.array(x["fact"])).alias("kept")))

    kept = listed.select(key, F.aggregate("_f", start, add)["kept"].alias("_k"))
    return kept.select(key, F.posexplode("_k").alias("place", "fact"))


def recall_block(facts: list[str]) -> str | None:
    return "\n- ".join([MEMORY_HEADER, *facts]) if facts else None
