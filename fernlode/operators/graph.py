"""Reference graph and navigation over ``symbols`` and ``refs``.

symbols(path, language, kind, name, line, column, start_line, end_line, signature),
refs(path, language, kind, name, line, column, import_path).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlode.functions.text import language_family, normalize_path
from fernlode.operators.blocks import file_pairs, walk
from fernlode.operators.spans import aligned_blocks, chunk_spans, nearest_spans
from fernlode.sources.logs import changed_lines
from fernlode.storage import broadcast_if_small, materialize

DAMPING, ITERATIONS, IMPORT_WEIGHT = 0.85, 30, 8.0
PRUNE_FILES, PRUNE_SHARE = 4, 4
#: Edges between two blocks of nodes that are held as one row.
SPLIT_EDGES = 1 << 16
#: Spans and lines meet by blocks of so many lines, and of twice, four times, ... as many.
BLOCK_LINES, BROADCAST_PATHS = 64, 400_000
#: Names that are broadcast at most, to number references where they arise.
BROADCAST_NAMES = 400_000

# Names that are not followed, by language.
STOP_NAMES = {
    "rust": "Self abstract as async await become box break const continue crate do dyn else enum extern false final fn for if impl in let loop macro match mod move mut override priv pub ref return self static struct super trait true try type typeof unsafe unsized use virtual where while yield Result Option Some None Ok".split(),
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return self try while with yield print".split(),
    "javascript": "arguments async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch target this throw true try typeof undefined var void while with yield".split(),
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var append cap clear close complex copy delete imag len make max min new panic print println real recover any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr false true iota nil err ctx ok".split(),
}


def with_family(rows: DataFrame) -> DataFrame:
    return rows.withColumn("family", language_family(F.col("language")))


def followed_references(refs: DataFrame) -> DataFrame:
    """References whose name is an identifier of at least three bytes and not a stop word of its language family."""
    stop = F.lit(False)
    for family, names in STOP_NAMES.items():
        stop = stop | ((F.col("family") == family) & F.col("name").isin(names))
    return with_family(refs).filter(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.char_length("name") >= 3) & ~stop)


def language_files(files: DataFrame) -> DataFrame:
    return with_family(files).groupBy("family").agg(F.count_distinct("path").alias("files"))


def defining_files(symbols: DataFrame) -> DataFrame:
    """(family, name, path) without names defined in at least 4 files and more than a quarter of the family's files."""
    own = materialize(with_family(symbols).groupBy("family", "name", "path").agg(F.count("*").alias("definitions")), "own", narrow=True)  # symbols are read once
    many = own.groupBy("family", "name").agg(F.count("*").alias("n"))
    files = own.groupBy("family").agg(F.count_distinct("path").alias("files"))
    pruned = many.join(F.broadcast(files), "family").filter((F.col("n") >= PRUNE_FILES) & (F.col("n") * PRUNE_SHARE > F.col("files")))  # one row a language
    return own.join(pruned.select("family", "name"), ["family", "name"], "left_anti")


def _named(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """uses(path, ids, ws, pairs) and defs(path, ids), a row for each file with the numbers of names that are defined, and the definitions; an imported file is a name of its own."""
    kept = materialize(defining_files(symbols), "definitions", narrow=True)
    defs, many = kept.select("family", "name", "path"), F.count("*").cast("double").alias("w")
    if imports is not None:
        own = imports.filter("src <> dst").groupBy(F.lit("\0import").alias("family"), F.col("dst").alias("name"), F.col("src").alias("path")).agg((F.count("*") * IMPORT_WEIGHT).alias("w"))
        defs = defs.unionByName(own.select("family", "name", F.col("name").alias("path")).distinct())
    names = materialize(defs.groupBy("family", "name").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "names", narrow=True)
    few = broadcast_if_small(names, BROADCAST_NAMES)
    # Without a broadcast, counts move to the names and not each use.
    uses = followed_references(refs).groupBy("family", "name", "path").agg(many) if few is names else followed_references(refs).select("family", "name", "path", F.lit(1.0).alias("w"))
    if imports is not None:
        uses = uses.unionByName(own)
    known = uses.join(few, ["family", "name"]).select("path", "id", "w", "n").repartition("path").groupBy("path", "id").agg(F.sum("w").alias("w"), F.first("n").alias("n"))
    files = known.groupBy("path").agg(F.collect_list(F.struct("id", "w")).alias("l"), F.sum("n").alias("pairs"))
    files = materialize(files.select("path", F.col("l.id").alias("ids"), F.col("l.w").alias("ws"), "pairs"), "uses")
    return files, materialize(defs.join(few, ["family", "name"]).groupBy("path").agg(F.collect_list("id").alias("ids")), "defining"), kept


def reference_edges(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): 1 for each occurrence and defining file, 8 more for each resolved import; files do not refer to themselves."""
    uses, defs, _ = _named(refs, symbols, imports)
    return file_pairs(uses, defs)


def reference_counters(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``graph_counters`` of the reference edges, which are counted where they arise and not put together."""
    uses, defs, kept = _named(refs, symbols, imports)
    edges = file_pairs(uses, defs, count_only=True).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"))
    return edges.crossJoin(kept.agg(F.count("*").alias("symbols_indexed")))


def graph_counters(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edge_count")).crossJoin(defining_files(symbols).agg(F.count("*").alias("symbols_indexed")))


def import_candidates(language: str, import_path: str, from_path: str) -> list[str]:
    """Paths that an import can mean, in order of preference."""
    base = from_path.rpartition("/")[0]
    if language == "rust":
        parts = [p for p in re.split(r"::", import_path) if p not in ("crate", "self", "super", "")][:-1] or [import_path]
        stems, tails = ["/".join(parts)], (".rs", "/mod.rs")
    elif language == "python":
        stems, tails = [import_path.strip(".").replace(".", "/")], (".py", "/__init__.py")
    elif language in ("javascript", "typescript", "tsx"):
        if not import_path.startswith("."):
            return []
        stems = [import_path]
        tails = ("", *(f"{i}{e}" for i in ("", "/index") for e in (".js", ".jsx", ".mjs", ".ts", ".tsx", ".cjs")))
    else:
        return []
    roots = (base,) if import_path.startswith(".") and language != "python" else ("", base)
    found = (normalize_path(f"{r}/{s}{t}" if r else f"{s}{t}") for r in roots for s in stems for t in tails)
    return list(dict.fromkeys(f for f in found if f))


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) for every import reference: of the candidates that exist, the first in path order."""
    candidates = F.udf(import_candidates, "array<string>")
    imports = refs.filter("import_path IS NOT NULL").select(F.col("path").alias("src"), "language", "import_path", "line", F.explode(candidates("language", "import_path", "path")).alias("dst"))
    hits = imports.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return hits.groupBy("src", "import_path", "line").agg(F.min("dst").alias("dst")).select("src", "dst")


def _start(nodes: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """(key, p): uniform over the seeds, or over all nodes where there are none."""
    if seeds is None or seeds.isEmpty():
        seeds = nodes
    n = seeds.distinct().count()
    return nodes.distinct().join(seeds.distinct().withColumn("_s", F.lit(1.0 / max(n, 1))), "node", "left").select(F.col("node").alias("key"), F.coalesce("_s", F.lit(0.0)).alias("p"))


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank (node, rank) with a fixed number of iterations over edges (src, dst, weight) between nodes.

    The start vector is the personalisation (uniform over seeds, or over all nodes); the mass of nodes without edges
    goes back by it.
    """
    edges = materialize(edges, "edges")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    start = _start(nodes, seeds)
    known = start.join(out.select(F.col("src").alias("key"), "total"), "key", "left").select("key", "p", F.col("total").isNull().alias("dangling"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    return walk(known, [(shares, known)], iterations, damping, SPLIT_EDGES)


def reference_ranks(refs: DataFrame, symbols: DataFrame, files: DataFrame, seeds: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """The PageRank (node, rank) of ``files`` (node) over ``reference_edges(refs, symbols)``, without that table.

    A name's uses times its defining files can be far more than either. Here a step goes from the files to the names they use and
    from the names to the files that define them; what comes back to the file itself is taken off, as files do not refer to themselves.
    """
    defs = defining_files(symbols).join(files.select(F.col("node").alias("path")).distinct(), "path", "left_semi")
    defs = materialize(defs.select(F.concat_ws("\0", "family", "name").alias("name"), "path"), "definitions")
    defined = materialize(defs.groupBy("name").agg(F.count("*").alias("files")), "defined", narrow=True)
    few = broadcast_if_small(defined, BROADCAST_NAMES)
    rows = followed_references(refs).select(F.concat_ws("\0", "family", "name").alias("name"), "path")
    rows = rows.groupBy("name", "path").agg(F.count("*").alias("w")) if few is defined else rows.withColumn("w", F.lit(1).cast("long"))
    # A file's names, those it defines and the sum of both meet in one shuffle by file.
    met = rows.join(few, "name").select("path", "name", "w", "files", F.lit(0).alias("own")).unionByName(defs.join(few, "name").select("path", "name", F.lit(0).cast("long").alias("w"), "files", F.lit(1).alias("own")))
    uses = met.repartition("path").groupBy("path", "name").agg(F.sum("w").alias("w"), F.first("files").alias("files"), F.max("own").alias("own")).filter("w > 0")
    uses = materialize(uses.withColumn("total", F.sum(F.col("w") * (F.col("files") - F.col("own"))).over(Window.partitionBy("path"))), "uses")
    out = uses.filter("total > 0").groupBy(F.col("path").alias("key")).agg(F.first("total").alias("total"), F.sum(F.col("w") * F.col("own")).alias("back"))
    start = _start(files, seeds)
    known = start.join(out, "key", "left").select("key", "p", F.col("total").isNull().alias("dangling"), F.coalesce(F.col("back") / F.col("total"), F.lit(0.0)).alias("own"), "total")
    known = materialize(known, "nodes", narrow=True)
    own = known.filter("own > 0").select(F.col("key").alias("file"), F.concat(F.lit("\0own "), "key").alias("mirror"), "own")
    names = defined.select(F.col("name").alias("key")).unionByName(own.select(F.col("mirror").alias("key")))
    shares = uses.filter("total > 0").select(F.col("path").alias("src"), F.col("name").alias("dst"), (F.col("w") / F.col("total")).alias("share"))
    shares = shares.unionByName(own.select(F.col("file").alias("src"), F.col("mirror").alias("dst"), (-F.col("own")).alias("share")))
    back = defs.select(F.col("name").alias("src"), F.col("path").alias("dst"), F.lit(1.0).alias("share")).unionByName(own.select(F.col("mirror").alias("src"), F.col("file").alias("dst"), F.lit(1.0).alias("share")))
    return walk(known.drop("total", "own"), [(shares, names), (back, known)], iterations, damping, SPLIT_EDGES)


def repo_map(edges: DataFrame | tuple[DataFrame, DataFrame], files: DataFrame, seeds: DataFrame | None = None, max_files: int | None = 20) -> DataFrame:
    """Files by rank, the score with eight decimals; ``edges`` is an edge table, or (refs, symbols) to rank without one."""
    nodes = files.select(F.col("path").alias("node"))
    ranks = reference_ranks(*edges, nodes, seeds) if isinstance(edges, tuple) else pagerank(edges, nodes, seeds)
    rows = ranks.select(F.col("node").alias("path"), "rank", F.format_string("%.8f", F.col("rank")).alias("score"))
    return rows if max_files is None else rows.orderBy(F.desc("rank"), "path").limit(max(max_files, 1))


def seed_files(files: DataFrame, terms: list[str], seed_paths: list[str] = (), literal: str | None = None) -> DataFrame:
    """files(path, text, terms): hit by the literal, by a seed path, or (without seed paths) by a shared term."""
    hit = F.lit(False)
    if literal:
        hit = hit | F.lower("path").contains(literal.lower()) | F.lower("text").contains(literal.lower())
    for p in seed_paths:
        hit = hit | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
    if not seed_paths and terms:
        hit = hit | F.arrays_overlap("terms", F.array(*[F.lit(t) for t in terms]))
    return files.filter(hit).select(F.col("path").alias("node"))


def span_blocks(start: Column, end: Column) -> Column:
    """The aligned intervals that cover the blocks of ``start`` to ``end``: (level, block) stands for 2^level blocks of BLOCK_LINES lines."""
    return F.when(end >= start, aligned_blocks(F.floor(start / BLOCK_LINES), F.floor(end / BLOCK_LINES) + 1))


def meet_spans(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points(path, at, ...) joined with spans(path, start_line, end_line, ...) that hold them, by equality of (path, level, block) alone.

    A span costs a row for each block of its cover, a point one for each level that its file's spans have; where all spans of a
    file lie within a block of lines or two that is one.
    """
    covered = spans.withColumn("_b", F.explode(span_blocks(F.col("start_line"), F.col("end_line")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    higher = covered.filter("_level > 0").groupBy("path").agg(F.collect_set("_level").alias("_higher"))  # at most a number for each level
    higher = broadcast_if_small(materialize(higher, "levels", narrow=True), BROADCAST_PATHS)
    levels = F.concat(F.array(F.lit(0)), F.coalesce("_higher", F.array().cast("array<int>")))
    placed = points.join(higher, "path", "left").withColumn("_level", F.explode(levels)).drop("_higher")
    placed = placed.withColumn("_block", F.floor(F.col("at") / BLOCK_LINES / F.pow(F.lit(2.0), F.col("_level"))))
    hits = placed.join(covered, ["path", "_level", "_block"])
    return hits.filter(F.col("at").between(F.col("start_line"), F.col("end_line"))).drop("_level", "_block")


def enclosing_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each reference with the smallest symbol span of its file that holds its line (first by line, column, name, kind among equals)."""
    return nearest_spans(refs, chunk_spans(symbols))


def overlapping_symbols(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols whose span holds a changed line (path, line); a span falls back to its line."""
    own = symbols.select("path", "name", "kind", F.coalesce("start_line", "line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line"))
    lines = changed.select("path", F.col("line").alias("at")).distinct()
    return meet_spans(own, lines).groupBy("path", "name", "kind", "start_line", "end_line").agg(F.count_distinct("at").alias("changed_lines"))


def detect_changes(diffs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that the new side of unified diffs (diff_id, diff) touches: path, name, kind, span and the number of changed lines."""
    return overlapping_symbols(symbols, changed_lines(diffs).select("path", "line"))


def confidence(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """refs with confidence: high for a name with at most one definition, or in (or importing) a defining file; else low."""
    count = symbols.groupBy("name").agg(F.count("*").alias("_n"))
    files = symbols.select("name", "path").distinct()
    near = files
    if imports is not None:
        near = near.unionByName(files.join(imports.select(F.col("src").alias("_s"), F.col("dst").alias("path")), "path").select("name", F.col("_s").alias("path"))).distinct()
    joined = refs.join(count, "name", "left").join(near.withColumn("_near", F.lit(True)), ["name", "path"], "left")
    return joined.withColumn("confidence", F.when((F.coalesce("_n", F.lit(0)) <= 1) | F.col("_near"), "high").otherwise("low")).drop("_n", "_near")


def find_references(refs: DataFrame, symbols: DataFrame, symbol: str, confident_only: bool = False, imports: DataFrame | None = None, max_results: int | None = 200) -> DataFrame:
    rows = confidence(refs.filter(F.col("name") == symbol), symbols.filter(F.col("name") == symbol), imports)
    rows = rows.filter("confidence = 'high'") if confident_only else rows
    rows = rows.select("path", "line", "column", "kind", "name", "confidence")
    return rows if max_results is None else rows.orderBy("path", "line", "kind", "column").limit(max_results)


def goto_definition(symbols: DataFrame, symbol: str, language: str | None = None, max_results: int | None = 200) -> DataFrame:
    rows = symbols.filter(F.col("name") == symbol)
    rows = rows if language is None else rows.filter(F.col("language") == language)
    total = rows.agg(F.count("*").alias("total"))
    kept = rows if max_results is None else rows.orderBy("path", "line", "kind").limit(max_results)
    cut = F.lit(False) if max_results is None else F.col("total") > max_results
    return kept.select("path", "line", "kind", "name").crossJoin(F.broadcast(total)).withColumn("truncated", cut)  # one row


def incoming_calls(refs: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Enclosing symbols of references to ``names`` (name)."""
    return enclosing_symbols(_named_by(refs, names), symbols)


def _named_by(refs: DataFrame, names: DataFrame) -> DataFrame:
    """The references to ``names`` (name), which move only where the names are too many for a broadcast."""
    own = materialize(names.groupBy("name").agg(F.count("*").alias("_n")).drop("_n"), "names", narrow=True)
    return refs.join(broadcast_if_small(own, BROADCAST_PATHS), "name", "left_semi")


def outgoing_calls(refs: DataFrame, symbols: DataFrame, symbol: str) -> DataFrame:
    """Definitions of the distinct names that the symbol's body refers to, itself excluded; the target's language does not matter."""
    body = enclosing_symbols(refs, symbols.filter(F.col("name") == symbol)).filter(F.col("ref_name") != symbol).select(F.col("ref_name").alias("name")).distinct()
    return symbols.join(body, "name").select("name", "path", "line", "column", "kind").distinct()


def impact(refs: DataFrame, symbols: DataFrame, symbol: str, max_depth: int = 2) -> DataFrame:
    """Symbols that reach ``symbol`` through references, each once at its first depth; the seed's definitions are left out.

    The spans are written once; every level takes the references to its own names alone and looks up their symbols.
    """
    spans = chunk_spans(symbols)
    own = refs.filter(F.col("name") == symbol)
    seen = spans.filter(F.col("name") == symbol).select(F.col("name").alias("symbol"), "path", "line").distinct()
    found = None
    for depth in range(1, max(max_depth, 1) + 1):
        level = nearest_spans(own, spans).filter("symbol <> ref_name").groupBy("symbol", "path", "line").agg(F.min(F.struct("ref_line", "ref_name")).alias("r"))
        level = level.join(seen, ["symbol", "path", "line"], "left_anti").select("symbol", "path", "line", F.lit(depth).cast("long").alias("depth"), F.col("r.ref_name").alias("via_symbol"), F.col("r.ref_line").alias("reference_line"))
        level = materialize(level, f"impact{depth}")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("symbol", "path", "line"))
        own = _named_by(refs, level.select(F.col("symbol").alias("name"))) if depth < max_depth else own
    return found


def trace_path(refs: DataFrame, symbols: DataFrame, start: str, goal: str, max_depth: int = 8) -> DataFrame:
    """One shortest chain of calls (step, name) from ``start`` to ``goal``; empty if there is none within the depth."""
    spark = refs.sparkSession
    symbols = materialize(symbols.select("path", "name", "kind", "line", "column", "start_line", "end_line"), "symbols", narrow=True)
    calls = incoming_calls(refs, symbols, symbols.select("name")).filter("symbol <> ref_name").select(F.col("symbol").alias("caller"), F.col("ref_name").alias("callee"))
    calls = materialize(calls.groupBy("caller", "callee").agg(F.count("*").alias("_n")).drop("_n"), "calls")
    paths = spark.createDataFrame([(start, [start])], "name string, path array<string>")
    seen = paths.select("name")
    for _ in range(max_depth):
        hit = paths.filter(F.col("name") == goal).orderBy("path").limit(1)
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("step", "name"))
        step = paths.join(calls, paths.name == calls.caller).groupBy("callee").agg(F.min("path").alias("path"))
        step = step.join(seen, step.callee == seen.name, "left_anti").select(F.col("callee").alias("name"), F.concat("path", F.array("callee")).alias("path"))
        paths = materialize(step, "trace")
        if paths.isEmpty():
            break
        seen = seen.unionByName(paths.select("name"))
    return paths.filter(F.col("name") == goal).orderBy("path").limit(1).select(F.posexplode("path").alias("step", "name"))


def read_symbol(symbols: DataFrame, corpus: DataFrame, symbol: str, max_matches: int = 20) -> DataFrame:
    """Matches in order; the body only where the symbol has exactly one definition."""
    from fernlode.functions.text import lines

    rows = symbols.filter(F.col("name") == symbol)
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy("path", "line", "kind", "signature").limit(max(max_matches, 1)).crossJoin(F.broadcast(total))  # one row
    body = F.array_join(F.slice(lines(F.col("text")), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return top.join(corpus.select(F.col("rel_path").alias("path"), "text"), "path", "left").select("path", "line", "kind", "signature", F.when(F.col("total") == 1, body).alias("body"), "total")


def referencing_symbols(refs: DataFrame, symbols: DataFrame, corpus: DataFrame, symbol: str, context_lines: int = 1) -> DataFrame:
    """Enclosing symbols of references to ``symbol`` with up to five lines of context on either side."""
    from fernlode.functions.text import lines

    k = min(context_lines, 5)
    rows = enclosing_symbols(refs.filter(F.col("name") == symbol), symbols)
    text = lines(F.col("text"))
    context = F.slice(text, F.greatest(F.col("ref_line") - k, F.lit(1)).cast("int"), (F.least(F.col("ref_line") + k, F.size(text)) - F.greatest(F.col("ref_line") - k, F.lit(1)) + 1).cast("int"))
    return rows.join(corpus.select(F.col("rel_path").alias("path"), "text"), "path").select("path", "symbol", "line", "kind", "ref_line", "ref_column", F.array_join(context, "\n").alias("context"))


def type_expansion(refs: DataFrame, symbols: DataFrame, selected: DataFrame, kinds: list[str], limit: int | None = 8) -> DataFrame:
    """Unselected files that define a type which selected files refer to, in (name, path) order, the first distinct paths."""
    used = with_family(refs).join(selected, "path", "left_semi").select("family", "name").distinct()
    defs = with_family(symbols).filter(F.col("kind").isin(kinds)).join(selected, "path", "left_anti").join(used, ["family", "name"], "left_semi")
    first = defs.groupBy("path").agg(F.min("name").alias("name"))
    return first if limit is None else first.orderBy("name", "path").limit(limit)


def auto_codemap(refs: DataFrame, symbols: DataFrame, selected: DataFrame, kinds: list[str], limit: int = 8) -> DataFrame:
    """The same within each root: unselected files (root_id, path) that define a type which selected files of their own root refer to.

    They are taken in the order of (family, name, root, path), each file once, until there are ``limit``.
    """
    key = ["root_id", "path"]
    used = with_family(refs).join(selected.select(*key).distinct(), key, "left_semi").select("root_id", "family", "name").distinct()
    defs = with_family(symbols).filter(F.col("kind").isin(kinds)).join(selected.select(*key).distinct(), key, "left_anti").join(used, ["root_id", "family", "name"], "left_semi")
    first = defs.groupBy(*key).agg(F.min(F.struct("family", "name")).alias("_f"))
    return first.orderBy("_f", *key).limit(limit).select(*key, F.col("_f.name").alias("name"))


def rank_of(column: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(column).orderBy(*order))
