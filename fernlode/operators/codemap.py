"""Code structure: definitions, references, block spans, summaries and structural search, by line grammars.

A line grammar names what starts a definition in each language; bodies end at the matching brace, or in
Python where the indentation falls back.  The parsers are plain functions over one text; ``parse_corpus`` runs
them over a corpus in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.functions.text import EXTENSION_LANGUAGE, language_from_fence, language_from_shebang
from fernlode.storage import map_batches

MAX_SIGNATURE, MAX_MEMBERS = 200, 200
BODY_LINES, COMMENT_LINES, GROUP_LINES = 4, 6, 4
_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
_GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+({_ID})"), ("struct", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+({_ID})"), ("enum", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+({_ID})"), ("trait", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+({_ID})"), ("impl", rf"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_ID})"), ("type", rf"(?:pub(?:\([^)]*\))?\s+)?type\s+({_ID})"), ("constant", rf"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?({_ID})\s*:"), ("module", rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+({_ID})"), ("macro", rf"macro_rules!\s*({_ID})")],
    "python": [("function", rf"(?:async\s+)?def\s+({_ID})"), ("class", rf"class\s+({_ID})"), ("constant", r"([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=(?!=)")],
    "javascript": [("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"), ("interface", rf"(?:export\s+)?interface\s+({_ID})"), ("enum", rf"(?:export\s+)?(?:const\s+)?enum\s+({_ID})"), ("type", rf"(?:export\s+)?type\s+({_ID})\s*(?:<[^=]*>)?="), ("function", rf"(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*=>"), ("constant", rf"(?:export\s+)?const\s+({_ID})\s*(?::[^=]+)?=")],
    "go": [("method", rf"func\s+\([^)]*\)\s*({_ID})"), ("function", rf"func\s+({_ID})"), ("struct", rf"type\s+({_ID})\s+struct"), ("interface", rf"type\s+({_ID})\s+interface"), ("type", rf"type\s+({_ID})"), ("constant", rf"const\s+({_ID})")],
    "java": [("class", rf"(?:[a-z]+\s+)*(?:class|record)\s+({_ID})"), ("interface", rf"(?:[a-z]+\s+)*@?interface\s+({_ID})"), ("enum", rf"(?:[a-z]+\s+)*enum\s+({_ID})"), ("method", rf"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+({_ID})\s*\(")],
    "c": [("struct", rf"(?:typedef\s+)?(?:struct|union)\s+({_ID})\s*\{{"), ("enum", rf"(?:typedef\s+)?enum\s+({_ID})\s*\{{"), ("macro", rf"#define\s+({_ID})"), ("function", rf"(?!return|else|if|for|while|switch)[A-Za-z_][\w\s*&:<>,~]*?\b({_ID})\s*\([^;]*$")],
    "ruby": [("function", r"def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("class", rf"class\s+({_ID})"), ("module", rf"module\s+({_ID})")],
    "php": [("function", rf"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?({_ID})"), ("class", rf"(?:(?:final|abstract)\s+)*class\s+({_ID})"), ("interface", rf"interface\s+({_ID})"), ("trait", rf"trait\s+({_ID})")],
}
_SAME = {"typescript": "javascript", "tsx": "javascript", "cpp": "c", "csharp": "java"}
_COMPILED = {lang: [(kind, re.compile(r"\s*" + p)) for kind, p in rules] for lang, rules in _GRAMMARS.items()}
_CALL = re.compile(rf"({_ID})\s*!?\(")
_TYPE = re.compile(r"\b([A-Z][A-Za-z0-9_]*)\b")
_IMPORTS = {
    "rust": re.compile(r"\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?"),
    "python": re.compile(r"\s*(?:from\s+([.\w]+)\s+)?import\s+([\w., *]+?)(?:\s+as\s+\w+)?\s*$"),
    "javascript": re.compile(r"\s*(?:import|export)\b(?:[^'\"]*\bfrom)?\s*['\"]([^'\"]+)['\"]|.*\brequire\(\s*['\"]([^'\"]+)['\"]"),
    "go": re.compile(r"\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
}
_CONTAINERS = ("struct", "enum", "trait", "impl", "class", "interface", "module")
SYMBOL_DDL = "kind string, name string, line long, column long, start_line long, end_line long, signature string, language string, members array<string>, member_signatures array<string>"
REF_DDL = "kind string, name string, line long, column long, import_path string, language string"


def detect_language(path: str, text: str) -> str | None:
    extension = path.rsplit("/", 1)[-1].rpartition(".")
    if extension[1] and extension[2].lower() == "md":
        return "markdown"
    return EXTENSION_LANGUAGE.get(extension[2].lower()) if extension[1] and extension[2].lower() in EXTENSION_LANGUAGE else language_from_shebang(text)


def _strip(line: str, language: str) -> str:
    """The line without strings and line comments, columns kept."""
    line = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'', lambda m: '"' + " " * (len(m[0]) - 2) + '"' if len(m[0]) > 1 else m[0], line)
    mark = "#" if language in ("python", "ruby") else "//"
    at = line.find(mark)
    return line if at < 0 else line[:at]


def block_end(rows: list[str], start: int, language: str) -> int:
    """Last line (from 0) of the block that starts on a line."""
    if language in ("python", "ruby"):
        indent = len(rows[start]) - len(rows[start].lstrip())
        last = start
        for k in range(start + 1, len(rows)):
            if rows[k].strip():
                deep = len(rows[k]) - len(rows[k].lstrip())
                if deep < indent or deep == indent and not (language == "ruby" and rows[k].strip() == "end"):
                    break
                last = k
                if language == "ruby" and deep == indent:
                    break
        return last
    depth, seen = 0, False
    for k in range(start, len(rows)):
        for c in _strip(rows[k], language):
            if c in "{(":
                depth, seen = depth + 1, seen or c == "{"
            elif c in "})":
                depth -= 1
        if depth <= 0 and (seen or _strip(rows[k], language).rstrip().endswith((";", ",")) or k == start and "{" not in "".join(rows[k : k + 2])):
            return k
    return start


def signature(rows: list[str], start: int) -> str:
    """Definition text up to its body, white space collapsed."""
    text = "\n".join(rows[start : start + 8])[:512]
    cut = re.search(r"\s*(?:\{|;|:\s*(?:\n|$)|=>|=(?!=))", text)
    return re.sub(r"\s+", " ", text[: cut.start()] if cut else rows[start]).strip()[:MAX_SIGNATURE]


def fences(text: str) -> list[tuple[int, int, str | None]]:
    """(first line, last line, language) of the fenced blocks' bodies, lines from 0; an outer fence hides inner ones."""
    out, open_ = [], None
    rows = text.split("\n")
    for k, row in enumerate(rows):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})(.*)$", row)
        if open_ is None and m:
            open_ = (k, m[1], language_from_fence(m[2].strip()))
        elif open_ is not None and m and m[1].startswith(open_[1]) and not m[2].strip():
            out.append((open_[0] + 1, k - 1, open_[2]))
            open_ = None
    if open_ is not None:
        out.append((open_[0] + 1, len(rows) - 1, open_[2]))
    return out


def symbols_of(text: str, language: str) -> list[dict]:
    """Definitions in (line, column, name) order."""
    if language == "markdown":
        out = []
        for a, b, inner in fences(text):
            if inner:
                own = "\n".join(text.split("\n")[a : b + 1])
                out += [{**s, **{f: s[f] + a for f in ("line", "start_line", "end_line")}} for s in symbols_of(own, inner)]
        return out
    rules, rows, out = _COMPILED.get(_SAME.get(language, language), []), text.split("\n"), []
    for k, row in enumerate(rows):
        bare = _strip(row, language) if language not in ("c", "cpp") else row
        for kind, rule in rules:
            m = rule.match(bare)
            if m:
                if kind == "constant" and language == "python" and row[:1].isspace():
                    break
                end = block_end(rows, k, language)
                out.append({"kind": kind, "name": m[1], "line": k + 1, "column": len(row[: m.start(1)].encode()) + 1, "start_line": k + 1, "end_line": end + 1, "signature": signature(rows, k), "language": language})
                break
    out.sort(key=lambda s: (s["line"], s["column"], s["name"]))
    for s in out:
        inside = [x for x in out if s["kind"] in _CONTAINERS and s["line"] < x["line"] and x["end_line"] <= s["end_line"]][:MAX_MEMBERS]
        s["members"], s["member_signatures"] = [x["name"] for x in inside], [x["signature"] for x in inside]
    return out


def references_of(text: str, language: str) -> list[dict]:
    """Calls, types and imports in (line, column, name) order; a definition's own name is no reference."""
    if language == "markdown":
        return [{**r, "line": r["line"] + a} for a, b, inner in fences(text) if inner for r in references_of("\n".join(text.split("\n")[a : b + 1]), inner)]
    defined = {(s["line"], s["name"]) for s in symbols_of(text, language)}
    importing, out = _IMPORTS.get(_SAME.get(language, language)), []

    def add(kind: str, name: str, line: int, row: str, at: int, path: str | None = None) -> None:
        out.append({"kind": kind, "name": name, "line": line, "column": len(row[:at].encode()) + 1, "import_path": path, "language": language})

    for k, row in enumerate(text.split("\n")):
        bare = _strip(row, language)
        found = importing.match(row) if importing else None
        if found and (language != "go" or "import" in row or row.strip().startswith('"')):
            parts = [g for g in found.groups() if g]
            if language == "python":
                base = found[1] or ""
                for name in re.findall(r"[\w.]+", found[2]):
                    add("import", name.rsplit(".", 1)[-1], k + 1, row, row.find(name), f"{base}.{name}".strip(".") if not base or base != name else base)
                    if base:
                        out[-1]["import_path"] = base
            elif language == "rust":
                for name in [n.strip() for n in (found[2] or found[1].rsplit("::", 1)[-1]).split(",") if n.strip()]:
                    add("import", name, k + 1, row, max(row.find(name), 0), f"{found[1]}::{name}" if found[2] else found[1])
            elif parts:
                add("import", parts[0].rsplit("/", 1)[-1], k + 1, row, max(row.find(parts[0]), 0), parts[0])
            continue
        used = set()
        for kind, rule in (("call", _CALL), ("type", _TYPE)):
            for m in rule.finditer(bare):
                if (k + 1, m[1]) not in defined and m.start(1) not in used:
                    used.add(m.start(1))
                    add(kind, m[1], k + 1, row, m.start(1))
    return sorted(out, key=lambda r: (r["line"], r["column"], r["name"]))


def parse_corpus(corpus: DataFrame) -> DataFrame:
    """corpus(root_id, rel_path, text) with language, symbols and refs; files of no known language have nulls."""
    schema = f"root_id string, path string, language string, symbols array<struct<{_ddl(SYMBOL_DDL)}>>, refs array<struct<{_ddl(REF_DDL)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, symbols, refs = [], [], []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                language = detect_language(path, text or "")
                languages.append(language)
                symbols.append(symbols_of(text or "", language) if language else None)
                refs.append(references_of(text or "", language) if language else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(symbols, _arrow(SYMBOL_DDL)), pa.array(refs, _arrow(REF_DDL))], names=["root_id", "path", "language", "symbols", "refs"])

    return map_batches(corpus.select("root_id", "rel_path", "text"), run, schema)


def _ddl(ddl: str) -> str:
    return ", ".join(f"{name}: {kind.replace('long', 'bigint')}" for name, kind in (c.split(" ") for c in ddl.split(", ")))


def _arrow(ddl: str) -> pa.DataType:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.list_(pa.struct([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))]))


def symbol_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("root_id", "path", F.explode("symbols").alias("s")).select("root_id", "path", "s.*")


def reference_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("root_id", "path", F.explode("refs").alias("r")).select("root_id", "path", "r.*")


def code_structure(parsed: DataFrame) -> DataFrame:
    """Per file: the symbols as text, and its token estimate."""
    text = F.array_join(F.transform("symbols", lambda s: F.concat(s["kind"], F.lit(" "), s["signature"])), "\n")
    rows = parsed.filter("language IS NOT NULL").select("root_id", "path", "language", F.size("symbols").alias("n_symbols"), text.alias("text"))
    return rows.withColumn("tokens", F.ceil(F.char_length("text") / 4).cast("long"))


def smallest_block(text: str, language: str, first: int, last: int) -> tuple[int, int] | None:
    """The smallest definition span that holds the lines first..last."""
    spans = [(s["start_line"], s["end_line"]) for s in symbols_of(text, language) if s["start_line"] <= first and last <= s["end_line"]]
    return min(spans, key=lambda s: (s[1] - s[0], s[0]), default=None)


_QUOTES = {"python": r"\"\"\".*?\"\"\"|'\'\'.*?'\'\'", "javascript": r"`(?:\\.|[^`\\])*`", "go": "`[^`]*`", "rust": r"r#\".*?\"#|'(?:\\.|[^'\\])'|'\w+"}
_PAIRS = {")": "(", "]": "[", "}": "{"}
MAX_ISSUES = 20


def syntax_issues(text: str, language: str | None) -> list[tuple[int, str]]:
    """(line, message) of brackets that do not pair, outside strings and comments; the first twenty, none for an unknown language or prose."""
    if language is None or language == "markdown":
        return []
    family = _SAME.get(language, language)
    comments = r"#[^\n]*" if family in ("python", "ruby") else r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    own = f"{_QUOTES[family]}|" if family in _QUOTES else ""
    skipped = rf"{comments}|{own}\"(?:\\.|[^\"\\\n])*\"" + ("" if family == "rust" else r"|'(?:\\.|[^'\\\n])*'")
    open_: list[tuple[str, int]] = []
    issues: list[tuple[int, str]] = []
    line, at = 1, 0
    for m in re.finditer(rf"(?s:{skipped})|(?P<mark>[()\[\]{{}}])", text):
        mark = m["mark"]
        if not mark:
            continue
        line += text.count("\n", at, m.start())
        at = m.start()
        if mark in _PAIRS.values():
            open_.append((mark, line))
        elif open_ and open_[-1][0] == _PAIRS[mark]:
            open_.pop()
        elif any(o == _PAIRS[mark] for o, _ in open_):  # what stands between was never closed
            while open_[-1][0] != _PAIRS[mark]:
                issues.append((open_[-1][1], f"unclosed {open_.pop()[0]}"))
            open_.pop()
        else:
            issues.append((line, f"unexpected {mark}"))
    issues += [(n, f"unclosed {o}") for o, n in open_]
    return sorted(set(issues))[:MAX_ISSUES]


def summarize(text: str, language: str | None) -> list[tuple[int, int, bool]]:
    """Segments (first, last, kept) of the structural view: long bodies, comments and import groups keep their first and last line."""
    rows = text.split("\n")
    n = len(rows)
    folds: list[tuple[int, int]] = []
    if language == "markdown":
        folds = [(a, b) for a, b, _ in fences(text) if b - a + 1 >= BODY_LINES]
    elif language:
        folds = [(s["start_line"], s["end_line"] - 1) for s in symbols_of(text, language) if s["kind"] in ("function", "method") and s["end_line"] - s["start_line"] + 1 >= BODY_LINES + 1]
        folds = [(a, b - 1) for a, b in folds if b - a >= 2]
        mark = ("#",) if language in ("python", "ruby") else ("//", "*", "/*")
        for pattern, least in ((lambda r: r.strip().startswith(mark), COMMENT_LINES), (lambda r: bool((_IMPORTS.get(_SAME.get(language, language)) or re.compile("(?!)")).match(r)), GROUP_LINES)):
            k = 0
            while k < n:
                j = k
                while j < n and pattern(rows[j]):
                    j += 1
                if j - k >= least:
                    folds.append((k + 1, j - 2))
                k = max(j, k + 1)
    out, at = [], 0
    for a, b in sorted(folds):
        if a >= at and b >= a:
            if a > at:
                out.append((at + 1, a, True))
            out.append((a + 1, b + 1, False))
            at = b + 1
    if at < n:
        out.append((at + 1, n, True))
    return out


def pattern_regex(pattern: str) -> re.Pattern:
    """A structural pattern with $META variables as a regular expression: white space is free, a repeated variable must match the same text."""
    out, seen = "", set()
    for part in re.findall(r"\$[A-Z_][A-Z0-9_]*|\s+|\w+|.", pattern.strip(), re.S):
        if part.startswith("$") and len(part) > 1:
            out += rf"(?P={part[1:]})" if part in seen else rf"(?P<{part[1:]}>[^\s,;(){{}}]+(?:\([^()]*\))?)"
            seen.add(part)
        else:
            out += r"\s+" if part.isspace() else re.escape(part) if part.isalnum() else rf"\s*{re.escape(part)}\s*"
    return re.compile(out)


def ast_search(text: str, pattern: str, max_results: int = 100) -> list[dict]:
    """Matches of a structural pattern: line, text and captures."""
    if "(#" in pattern:
        raise ValueError("predicates are not supported")
    found = []
    for m in pattern_regex(pattern).finditer(text):
        found.append({"line": text.count("\n", 0, m.start()) + 1, "start": m.start(), "end": m.end(), "text": m[0].strip(), "captures": m.groupdict()})
        if len(found) >= max_results:
            break
    return found


def ast_edit(text: str, pattern: str, template: str) -> str:
    """Every match replaced by the template with ${capture} filled in; of overlapping matches the outermost."""
    out, last = [], 0
    for m in ast_search(text, pattern, 10**9):
        if m["start"] < last:
            continue
        new = re.sub(r"\$\{(\w+)\}", lambda c, m=m: m["captures"].get(c[1], c[0]), template)
        lead = len(text[m["start"] : m["end"]]) - len(text[m["start"] : m["end"]].lstrip())
        tail = len(text[m["start"] : m["end"]].rstrip())
        out.append(text[last : m["start"] + lead] + new)
        last = m["start"] + tail
    return "".join(out) + text[last:]
