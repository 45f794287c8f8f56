"""Composite answers: built contexts, workspace contexts, rendered trees and maps, rename scopes.

The ranked tables are distributed; what these functions put together on the driver is bounded by their own limits
(files, characters, tokens).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlode.functions.hashing import context_hash
from fernlode.operators import codemap, context, edits, graph, search

MAP_CHARS, TREE_BYTES, GIT_CHARS = 12_000, 16_000, 20_000
# Directories that a tree leaves out, uncounted.
NOISE = ("node_modules", ".git", ".hg", ".svn", "target", "dist", "build", "out", "coverage", "vendor", ".next", ".nuxt", ".turbo", ".cache", ".venv", "venv", "__pycache__", ".idea", ".gradle", "DerivedData", "Pods")
SECTIONS = ("file_map", "tree", "code", "contents", "diff", "meta_prompts", "instructions")
# What starts a line that binds a name, by language family.
BINDINGS = {"rust": ("let ", "let mut ", "const ", "static "), "python": ("",), "javascript": ("let ", "const ", "var "), "go": ("var ", "const ")}


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def build_context(corpus: DataFrame, ranks: DataFrame, query: str, token_budget: int, max_files: int = 20) -> dict:
    """Fused candidates, greedily rendered within the budget, with a manifest of what came in, what did not, and findings of secrets."""
    paths = corpus.select(F.col("rel_path").alias("path"), "root_id", "text")
    hits = search.content_search(corpus, query, max_results=max(4 * max_files, 50)).select(F.col("rel_path").alias("path"), "score", "line")
    found = search.path_search(corpus.withColumn("size", F.octet_length("text")), query, max_results=max(4 * max_files, 50)).select(F.col("rel_path").alias("path"), "score")
    fused = context.fuse(hits.select("path", "score"), found, ranks, query)
    top = fused.orderBy(F.desc("fused"), "path").limit(4 * max_files)
    rows = top.join(paths, "path").orderBy(F.desc("fused"), "path").collect()  # at most 4 * max_files files
    lines = {r["path"]: r["lines"] for r in hits.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("lines")).collect()}  # within the search's limit
    candidates, forms = [], {}
    for r in rows:
        own = r["text"].split("\n")
        language = codemap.detect_language(r["path"], r["text"])
        outline = "\n".join(f"{s['line']}: {s['signature']}" for s in codemap.symbols_of(r["text"], language)) if language else ""
        slices = "\n...\n".join("\n".join(own[max(n - 3, 0) : n + 2]) for n in lines.get(r["path"], [])[: context.MAX_SLICES])
        forms[r["path"]] = {"full": r["text"], "codemap": outline, "slices": slices}
        cost = {mode: tokens(f"## {r['path']} ({mode})\n{text}\n\n") for mode, text in forms[r["path"]].items()}
        candidates.append({"path": r["path"], "full": cost["full"], "codemap": cost["codemap"] if outline else None, "slices": cost["slices"], "hits": bool(slices)})
    included, excluded = context.allocate(candidates, token_budget, max_files)
    text = "".join(f"## {i['path']} ({i['mode']})\n{forms[i['path']][i['mode']]}\n\n" for i in included)
    chosen = corpus.filter(F.col("rel_path").isin([i["path"] for i in included]))
    findings = [tuple(r) for r in context.scan_secrets(chosen).select("rel_path", "line", "kind").distinct().orderBy("rel_path", "line", "kind").collect()]
    return {"context": text, "tokens": tokens(text), "hash": context_hash(text), "included": included, "excluded": excluded, "sensitive_findings": findings}


def workspace_context(sections: dict[str, str], include: list[str] = ()) -> dict:
    """The sections in their fixed order (file map and contents unless others are asked for), tokens of each, and a hash."""
    wanted = [s for s in SECTIONS if s in (include or ("file_map", "contents")) and sections.get(s)]
    text = "\n\n".join(f"<{s}>\n{sections[s]}\n</{s}>" for s in wanted)
    return {"context": text, "section_tokens": {s: tokens(sections[s]) for s in wanted}, "hash": context_hash(text)}


def render_map(rows: list[tuple[str, str]], cap: int = MAP_CHARS) -> str:
    """Lines of (path, score) up to the cap, one at least."""
    out, size = [], 0
    for path, score in rows:
        line = f"{score} {path}"
        if out and size + len(line) + 1 > cap:
            break
        out.append(line)
        size += len(line) + 1
    return "\n".join(out)


def render_tree(nodes: DataFrame, mode: str = "auto", cap: int = TREE_BYTES, max_siblings: int = 100) -> str:
    """A tree of (parent, name, kind, depth); 'auto' gives up files, then depth, until it fits the cap in bytes."""
    # Folders sort before files, so the first max_siblings of a folder are those that any rendering can show; the rest are only counted.
    own = nodes.filter(~F.col("name").isin(*NOISE)).select("parent", "name", "kind")
    first = own.withColumn("_k", F.row_number().over(Window.partitionBy("parent").orderBy("kind", "name"))).filter(F.col("_k") <= max_siblings)
    counts = {r["parent"]: (r["n"], r["dirs"]) for r in own.groupBy("parent").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "dir").alias("dirs")).collect()}  # a row a folder
    children: dict[str, list[tuple[str, str]]] = {}
    for parent, name, kind, _ in first.orderBy("parent", "_k").collect():  # at most max_siblings rows a folder
        children.setdefault(parent, []).append((name, kind))

    def render(folders_only: bool, depth: int | None) -> str:
        out: list[str] = []

        def visit(parent: str, level: int, indent: str) -> None:
            own = [(n, k) for n, k in children.get(parent, []) if k == "dir" or not folders_only]
            for n, k in own:
                out.append(f"{indent}{n}{'/' if k == 'dir' else ''}")
                path = f"{parent}/{n}" if parent else n
                if k == "dir" and (depth is None or level < depth):
                    visit(path, level + 1, indent + "  ")
                elif k == "dir":
                    out.append(f"{indent}  … {sum(1 for p in children if p == path or p.startswith(path + '/'))} folders below")
            more = counts.get(parent, (0, 0))[folders_only] - len(own)
            if more > 0:
                out.append(f"{indent}… {more} more")

        visit("", 1, "")
        return "\n".join(out)

    if mode != "auto":
        return render(mode == "folders", None)
    text = ""
    for folders_only, depth in ((False, None), (False, 3), (True, None), (True, 3), (True, 1)):
        text = render(folders_only, depth)
        if len(text.encode()) <= cap:
            return text
    return text.encode()[:cap].decode(errors="ignore")


def snapped_range(text: str, path: str, first: int, last: int) -> dict:
    """The smallest parsed block that holds a range, or the range itself with the reason."""
    language = codemap.detect_language(path, text)
    if language is None:
        return {"first": first, "last": last, "snapped": False, "reason": "unsupported language"}
    block = codemap.smallest_block(text, language, first, last)
    if block is None:
        return {"first": first, "last": last, "snapped": False, "reason": "no block holds the range"}
    return {"first": block[0], "last": block[1], "snapped": True, "reason": None}


def rename_scope(symbols: DataFrame, refs: DataFrame, imports: DataFrame, corpus: DataFrame, symbol: str, definition: str) -> DataFrame:
    """(path, line) of the occurrences to rename: the defining file and the files that import it.

    The scope is refused where one of the importers defines the name itself or binds it at the start of a line.
    """
    importers = imports.filter(F.col("dst") == definition).select(F.col("src").alias("path")).distinct()
    clash = symbols.filter(F.col("name") == symbol).join(importers, "path", "left_semi").select("path")
    escaped = re.escape(symbol)
    binding = "|".join(rf"(?:{re.escape(p)}){escaped}\s*(?::[^=]*)?=[^=]" for p in sorted({b for own in BINDINGS.values() for b in own}))
    bound = corpus.select(F.col("rel_path").alias("path"), "text").join(importers, "path", "left_semi").filter(F.col("text").rlike(rf"(?m)^\s*(?:{binding})")).select("path")
    shadowed = sorted({r["path"] for r in clash.unionByName(bound).distinct().orderBy("path").limit(20).collect()})
    if shadowed:
        raise edits.EditError(f"{symbol} is also bound in {', '.join(shadowed)}")
    own = symbols.filter((F.col("name") == symbol) & (F.col("path") == definition)).select("path", "line")
    uses = refs.filter(F.col("name") == symbol)
    scope = importers.unionByName(corpus.sparkSession.createDataFrame([(definition,)], "path string"))
    # An importer that takes the name under an alias only changes where it imports it.
    aliased = corpus.select(F.col("rel_path").alias("path"), "text").filter(F.col("text").rlike(rf"\b{escaped}\s+as\s+\w+")).select("path").withColumn("_alias", F.lit(True))
    picked = uses.join(scope, "path", "left_semi").join(aliased, "path", "left").filter(F.col("_alias").isNull() | (F.col("kind") == "import")).select("path", "line")
    return own.unionByName(picked).distinct()


def rename_plan(symbols: DataFrame, refs: DataFrame, corpus: DataFrame, old: str, new: str, definition: str) -> DataFrame:
    """The edit plan of a rename."""
    imports = graph.resolve_imports(refs, corpus.select(F.col("rel_path").alias("path")))
    return edits.plan_rename(corpus, rename_scope(symbols, refs, imports, corpus, old, definition), old, new)
