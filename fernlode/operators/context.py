"""Secrets, clustering of hits, score fusion, scouting, budgeted selection and selection algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlode.functions.text import ascii_lower, field_score, lines, query_terms, split_assignment

GAP, WIDEN, MAX_RANGES, MAX_SLICES = 4, 2, 5, 3
SEARCH_WEIGHT, REPO_WEIGHT, PATH_WEIGHT = 0.55, 0.35, 0.10
CONTENT_HIT, PATH_SHARE = 2_000_000, 0.25
# Field weights of symbol search and tool search.
SYMBOL_FIELDS = {"name": 80, "kind": 24, "signature": 16, "display_path": 4, "path": 4}
MEMBER_FIELDS = {"members": 10, "member_signatures": 4}
TOOL_FIELDS = {"name": 40, "description": 12, "params": 8, "param_descriptions": 4}
# Key suffixes of secrets.
SECRET_KEYS = ("api_key", "apikey", "auth_token", "client_secret", "password", "private_key", "secret", "secret_key", "token")
# What each kind of token starts with, and how many characters follow at least.
SECRET_TOKENS = {"aws_access_key_id": ("(?:AKIA|ASIA)", 16), "github_token": ("(?:gh[pousr]_|github_pat_)", 20), "openai_api_key": ("sk-", 21), "slack_token": ("xox[bpars]-", 12)}
# A line that breaks any rule has one of these.
SECRET_LINE = "|".join(["[=:]", " PRIVATE KEY-----", *(start for start, _ in SECRET_TOKENS.values())])


def secret_kinds(line: Column) -> Column:
    """Names of the rules that a line breaks, in order."""
    tail = "[A-Za-z0-9_.-]"
    key, value = split_assignment(line)
    key = F.replace(ascii_lower(F.regexp_replace(key, r"^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$", "")), F.lit("-"), F.lit("_"))
    value = F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"^['\"`;,]+|['\"`;,]+$", "")
    ends = F.lit(False)
    for k in SECRET_KEYS:
        ends = ends | key.endswith(k)
    generic = ends & (F.octet_length(value) >= 16) & ~value.contains(" ") & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    rules = {
        "private_key_block": line.contains("-----BEGIN ") & line.contains(" PRIVATE KEY-----"),
        **{name: line.rlike(f"{start}{tail}{{{n},}}") for name, (start, n) in SECRET_TOKENS.items()},
        "generic_secret_assignment": F.coalesce(generic, F.lit(False)),
    }
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())


def scan_secrets(corpus: DataFrame) -> DataFrame:
    """(root_id, rel_path, line, kind): one row for each rule and line."""
    rows = corpus.select("root_id", "rel_path", F.posexplode(lines(F.col("text"))).alias("_k", "_line")).filter(F.col("_line").rlike(SECRET_LINE))
    return rows.select("root_id", "rel_path", (F.col("_k") + 1).cast("long").alias("line"), F.explode(secret_kinds(F.col("_line"))).alias("kind"))


def cluster_lines(hits: DataFrame, key: list[str], gap: int = GAP, widen: int = WIDEN, limit: int | None = MAX_RANGES) -> DataFrame:
    """Islands of hit lines: a new one after a gap over ``gap``, widened on both sides (the end is not cut to the file), the first few."""
    order = Window.partitionBy(*key).orderBy("line")
    rows = hits.groupBy(*key, "line").agg(F.count("*").alias("_n"))
    new = F.coalesce(F.col("line") - F.lag("line").over(order) > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows if limit is None else rows.filter(F.col("island") <= limit)
    return rows.groupBy(*key, "island").agg(F.greatest(F.min("line") - widen, F.lit(1)).alias("start_line"), (F.max("line") + widen).alias("end_line"))


def hit_slices(hits: DataFrame, key: list[str], limit: int = MAX_SLICES, widen: int = WIDEN) -> DataFrame:
    """The first hit lines of each file with their neighbours, not merged."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    return hits.select(*key, "line").distinct().withColumn("_r", rank).filter(F.col("_r") <= limit).select(*key, F.greatest(F.col("line") - widen, F.lit(1)).alias("start_line"), (F.col("line") + widen).alias("end_line"))


def merge_ranges(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Ranges of equal label that touch or overlap, in start order, become one."""
    order = Window.partitionBy(*key).orderBy("start_line", "end_line")
    far = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("label").eqNullSafe(F.lag("label").over(order))
    rows = ranges.withColumn("_new", F.coalesce(~same | (F.col("start_line") > far + 1), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("label").alias("label")).drop("_run")


def field_search(rows: DataFrame, query: str, weights: dict[str, int], all_terms: bool = True, lists: dict[str, int] | None = None) -> DataFrame:
    """Rows with a score: the sum over terms, fields and the elements of lists; every term must hit (or, for tool search, any)."""
    terms = query_terms(query)
    of_list = lambda f, t, w: F.coalesce(F.aggregate(F.transform(f, lambda x: field_score(F.coalesce(x, F.lit("")), t, w)), F.lit(0), lambda a, b: a + b), F.lit(0))
    by_term = [sum((field_score(F.coalesce(F.col(f).cast("string"), F.lit("")), t, w) for f, w in weights.items()), F.lit(0)) for t in terms]
    by_term = [sum((of_list(f, t, w) for f, w in (lists or {}).items()), s) for t, s in zip(terms, by_term)]
    out = rows.withColumn("score", sum(by_term, F.lit(0)).cast("long"))
    hit = F.lit(bool(terms)) if all_terms else F.lit(False)
    for s in by_term:
        hit = hit & (s > 0) if all_terms else hit | (s > 0)
    return out.filter(hit)


def symbol_search(symbols: DataFrame, query: str, language: str | None = None, kind: str | None = None, max_results: int | None = 50) -> DataFrame:
    rows = symbols if language is None else symbols.filter(F.col("language") == language)
    rows = rows if kind is None else rows.filter(F.lower("kind") == kind.lower())
    weights = {f: w for f, w in SYMBOL_FIELDS.items() if f in rows.columns}
    out = field_search(rows, query, weights, lists={f: w for f, w in MEMBER_FIELDS.items() if f in rows.columns})
    return out if max_results is None else out.orderBy(F.desc("score"), "path", "line", "kind", "name").limit(max_results)


def tool_search(tools: DataFrame, query: str, max_results: int | None = 8) -> DataFrame:
    rows = field_search(tools, query, TOOL_FIELDS, all_terms=False).select("name", "score")
    return rows if max_results is None else rows.orderBy(F.desc("score"), "name").limit(max_results)


def path_relevance(path: Column, query: str) -> Column:
    """Share of the query's terms (repeats counted) that the path holds."""
    import re

    terms = [t.lower() for t in re.split(r"[^A-Za-z0-9_]+", query) if t]
    hits = sum((ascii_lower(path).contains(t).cast("int") for t in terms), F.lit(0))
    return hits / len(terms) if terms else F.lit(0.0)


def fuse(content_hits: DataFrame, path_hits: DataFrame, ranks: DataFrame, query: str) -> DataFrame:
    """Candidates (path, search, repo, relevance, fused) from hits (path, score), path hits (path, score) and ranks (path, rank).

    Each signal is divided by its maximum; the three come together by one union and one grouping, not by outer joins.
    """
    null = F.lit(None).cast("double")
    parts = content_hits.select("path", (F.greatest("score", F.lit(0)) + CONTENT_HIT).cast("double").alias("search"), null.alias("repo"))
    parts = parts.unionByName(path_hits.select("path", (F.col("score") * PATH_SHARE).alias("search"), null.alias("repo")))
    parts = parts.unionByName(ranks.select("path", null.alias("search"), F.col("rank").cast("double").alias("repo")))
    rows = parts.groupBy("path").agg(F.coalesce(F.sum("search"), F.lit(0.0)).alias("search"), F.coalesce(F.sum("repo"), F.lit(0.0)).alias("repo")).withColumn("relevance", path_relevance(F.col("path"), query))
    top = rows.agg(*[F.max(c).alias(f"_{c}") for c in ("search", "repo", "relevance")])
    part = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0)
    fused = SEARCH_WEIGHT * part("search") + REPO_WEIGHT * part("repo") + PATH_WEIGHT * part("relevance")
    return rows.crossJoin(F.broadcast(top)).withColumn("fused", fused).filter("fused > 0").select("path", "search", "repo", "relevance", "fused")  # one row


def scout(candidates: DataFrame, hits: DataFrame, max_files: int = 12) -> DataFrame:
    """The best files with the ranges of their hits (a file without hits has none)."""
    top = candidates.orderBy(F.desc("fused"), "path").limit(max(max_files, 1))
    ranges = cluster_lines(hits.join(F.broadcast(top.select("path")), "path", "left_semi"), ["path"])  # at most max_files rows
    listed = ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("ranges"))
    return top.join(listed, "path", "left").select("path", "fused", F.coalesce("ranges", F.array().cast("array<struct<start_line:bigint,end_line:bigint>>")).alias("ranges"))


def allocate(candidates: list[dict], budget: int, max_files: int = 20) -> tuple[list[dict], list[dict]]:
    """Greedy allocation over ranked candidates (path, full, codemap, slices, hits): (included, excluded).

    The costs are token counts of the rendered forms, or None where a form does not exist. The first form that fits is taken;
    a file that does not fit does not stop later ones.
    """
    included, excluded, spent = [], [], 0
    for c in candidates:
        if len(included) >= max_files:
            excluded.append({"path": c["path"], "reason": "max_files"})
            continue
        modes = [("full", c.get("full")), ("codemap", c.get("codemap"))]
        if c.get("hits") and (c.get("codemap") is None or (c.get("full") or 0) > budget // 2):
            modes.append(("slices", c.get("slices")))
        mode = next(((m, cost) for m, cost in modes if cost is not None and spent + cost <= budget), None)
        if mode is None:
            excluded.append({"path": c["path"], "reason": "budget"})
        else:
            spent += mode[1]
            included.append({"path": c["path"], "mode": mode[0], "tokens": mode[1]})
    return included, excluded


def select_ops(selection: DataFrame, entries: DataFrame, op: str) -> DataFrame:
    """Selection algebra over (root_id, path, mode, seq): add and set keep the last entry of a key, remove drops keys, promote and demote change modes."""
    key = ["root_id", "path"]
    if op == "clear":
        return selection.limit(0)
    if op == "remove":
        return selection.join(entries.select(*key).distinct(), key, "left_anti")
    if op in ("promote", "demote"):
        mode = "full" if op == "promote" else "codemap_only"
        hit = entries.select(*key).distinct().withColumn("_hit", F.lit(True))
        return selection.join(hit, key, "left").withColumn("mode", F.when(F.col("_hit"), mode).otherwise(F.col("mode"))).drop("_hit")
    rows = entries if op == "set" else selection.unionByName(entries)
    return rows.groupBy(*key).agg(F.max_by("mode", "seq").alias("mode"), F.max("seq").alias("seq"))


def selection_files(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected files that still exist, with token estimates of full files."""
    return selection.join(catalog.select("root_id", F.col("rel_path").alias("path"), "size"), ["root_id", "path"]).withColumn("tokens", F.when(F.col("mode") == "full", F.ceil(F.col("size") / 4)).otherwise(0).cast("long"))


def selection_summary(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files and token estimates of a selection, by mode."""
    return selection_files(selection, catalog).groupBy("mode").agg(F.count("*").alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def selection_preview(selection: DataFrame, catalog: DataFrame, entries: DataFrame, op: str) -> DataFrame:
    """What a selection would be after an operation: files and tokens by mode; the selection itself stays."""
    return selection_summary(select_ops(selection, entries, op), catalog)


def secret_slices(corpus: DataFrame, slices: DataFrame) -> DataFrame:
    """Findings within line ranges (root_id, rel_path, start_line, end_line): a range that meets a private key finds it even where it holds only its body.

    A key runs from its first line to its end mark, or to the end of the file.
    """
    marks = lines(F.col("text"))
    rows = corpus.select("root_id", "rel_path", F.size(marks).alias("_n"), F.transform(marks, lambda x, k: F.when(x.contains("-----BEGIN ") & x.contains(" PRIVATE KEY-----"), k + 1)).alias("_b"), F.transform(marks, lambda x, k: F.when(x.contains("-----END ") & x.contains(" PRIVATE KEY-----"), k + 1)).alias("_e"))
    present = lambda c: F.filter(c, lambda x: x.isNotNull())
    rows = rows.select("root_id", "rel_path", "_n", present("_b").alias("_b"), present("_e").alias("_e")).filter(F.size("_b") > 0)
    end = F.col("_e")
    spans = F.transform("_b", lambda b: F.struct(b.alias("a"), F.coalesce(F.array_min(F.filter(end, lambda e: e >= b)), F.col("_n")).alias("z")))
    keys = rows.select("root_id", "rel_path", F.explode(spans).alias("k"))
    hit = slices.join(keys, ["root_id", "rel_path"]).filter((F.col("start_line") <= F.col("k.z")) & (F.col("k.a") <= F.col("end_line")))
    blocks = hit.select("root_id", "rel_path", F.greatest("start_line", "k.a").cast("long").alias("line"), F.lit("private_key_block").alias("kind"))
    found = scan_secrets(corpus.join(slices.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_semi"))
    within = found.join(slices, ["root_id", "rel_path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("root_id", "rel_path", "line", "kind")
    return within.unionByName(blocks).distinct()


def last_reason(exclusions: DataFrame, selected: DataFrame) -> DataFrame:
    """Exclusions (path, reason, seq) once for each path, the last reason wins, without selected paths."""
    return exclusions.groupBy("path").agg(F.max_by("reason", "seq").alias("reason")).join(selected.select("path"), "path", "left_anti")


def first_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in order; of equal keys the earliest table's row stays."""
    rows = tables[0].withColumn("_t", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("_t", F.lit(k)))
    best = rows.groupBy(key).agg(F.min_by(F.struct(*tables[0].columns), "_t").alias("r"))
    return best.select("r.*")


def file_tree(entries: DataFrame, max_depth: int | None = None, max_siblings: int = 100) -> DataFrame:
    """Directories and files as (parent, name, kind, files, bytes): at most ``max_siblings`` of a parent, directories first, by name."""
    parts = F.split("rel_path", "/")
    levels = entries.select("rel_path", "size", parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    rows = levels.select(F.array_join(F.slice("_p", F.lit(1), F.col("depth") - 1), "/").alias("parent"), F.element_at("_p", F.col("depth")).alias("name"), F.when(F.col("depth") == F.size("_p"), "file").otherwise("dir").alias("kind"), "depth", "size")
    rows = rows if max_depth is None else rows.filter(F.col("depth") <= max_depth)
    nodes = rows.groupBy("parent", "name", "kind", "depth").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("kind", "name"))
    return nodes.withColumn("_r", rank).filter(F.col("_r") <= max_siblings).drop("_r")
