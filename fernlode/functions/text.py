"""Text, identifier, path and number functions, as Spark columns wherever a column can express them."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that a query does not search for.
QUERY_STOPWORDS = ["api", "code", "common", "config", "data", "error", "file", "files", "find", "get", "handling", "module", "modules", "new", "old", "project", "repo", "repository", "set", "test", "tests", "util", "utils"]

# Language by file extension, interpreter and fence tag.
EXTENSION_LANGUAGE = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "phtml": "php",
}
INTERPRETER_LANGUAGE = {"python": "python", "pypy": "python", "node": "javascript", "nodejs": "javascript", "bun": "javascript", "deno": "typescript", "ts-node": "typescript", "tsx": "typescript", "ruby": "ruby", "jruby": "ruby", "php": "php"}
FENCE_LANGUAGE = {
    "rust": "rust", "rs": "rust", "python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "jsx": "javascript", "node": "javascript",
    "typescript": "typescript", "ts": "typescript", "tsx": "tsx", "go": "go", "golang": "go", "java": "java", "c": "c", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp",
    "csharp": "csharp", "cs": "csharp", "c#": "csharp", "ruby": "ruby", "rb": "ruby", "php": "php",
}


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; Spark's lower() is Unicode."""
    return F.translate(c, UPPER, LOWER)


def tokenize_text(c: Column, case_sensitive: bool = False) -> Column:
    """Maximal runs of Unicode letters and numbers, lower-cased unless case-sensitive."""
    return F.array_remove(F.split(c if case_sensitive else F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), "")


def tokenize_query(query: str, case_sensitive: bool = False) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query if case_sensitive else query.lower())))


def lines(text: Column) -> Column:
    """Lines without terminators: CRLF counts as LF, no empty last line, no lines in an empty text."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(flat, "\n", -1))


def normalized_doc_len(tokens: Column, n_lines: Column) -> Column:
    return F.greatest(tokens, n_lines, F.lit(1))


def smart_case(pattern: str) -> bool:
    """Case-sensitive exactly when the pattern has an upper-case character."""
    return any(c.isupper() for c in pattern)


def glob_regex(glob: str) -> str:
    """Anchored Java regex of a glob; one without '/' matches the base name at any depth; '*' stays within a directory."""
    out, i = ("" if "/" in glob else "(?:.*/)?"), 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex("/" + part)[2:-1] for part in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.sub(r"([\\.+()|{}^$\[\]])", r"\\\1", glob[i]), i + 1
    return f"^{out}$"


def identifier_terms(text: str) -> list[str]:
    """Sorted query terms of free text: whole identifiers, their '_' parts and camel-case parts, without short or stop words."""
    terms: set[str] = set()
    for whole in re.split(r"[^A-Za-z0-9_]+", text):
        for part in {whole, *whole.split("_")}:
            for term in (part, *field_terms(part)):
                term = term.lower()
                if len(term) >= 3 and any(c.isalpha() for c in term) and term not in QUERY_STOPWORDS:
                    terms.add(term)
    return sorted(terms)


def field_terms(field: str) -> list[str]:
    """Lower-case camel, snake and digit parts of an identifier; an upper-case run breaks before its last letter if a lower-case one follows."""
    return [m.lower() for run in re.findall(r"[A-Za-z0-9]+", field) for m in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+[a-z0-9]*", run)]


def field_terms_column(c: Column) -> Column:
    """The same as a column."""
    parts = F.flatten(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), 0), lambda run: F.regexp_extract_all(run, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+[a-z0-9]*"), 0)))
    return F.transform(parts, F.lower)


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in re.split(r"[^A-Za-z0-9]+", query) if t))


def field_score(field: Column, term: str, weight: int) -> Column:
    """4 x weight for equality, 2 x for a token, 1 x for a token's beginning, half (integer) for a substring."""
    low = ascii_lower(field)
    tokens = field_terms_column(field)
    score = F.when(low == term, 4 * weight).when(F.array_contains(tokens, term), 2 * weight)
    if len(term) >= 2:
        score = score.when(F.exists(tokens, lambda t: t.startswith(term)), weight).when(low.contains(term), weight // 2)
    return F.coalesce(score.otherwise(0), F.lit(0))


def language_family(language: Column) -> Column:
    return F.when(language.isin("typescript", "tsx"), "javascript").otherwise(language)


def language_from_path(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(ascii_lower(path), r"\.([^./]*)$", 1))


def language_from_shebang(source: str) -> str | None:
    first = (source.splitlines() or [""])[0].lstrip("﻿")
    if not first.startswith("#!"):
        return None
    words = first[2:].split()
    names = [w.rsplit("/", 1)[-1] for w in words]
    if names[:1] == ["env"]:
        names = [n for n, w in zip(names[1:], words[1:]) if not w.startswith("-") and "=" not in w]
    return INTERPRETER_LANGUAGE.get(names[0].rstrip("0123456789.").lower()) if names else None


def language_from_fence(info: str) -> str | None:
    return FENCE_LANGUAGE.get(re.split(r"[\s,{]", info, maxsplit=1)[0].lstrip(".").lower())


def count_tokens(c: Column) -> Column:
    """Token estimate without a vocabulary: a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(c) / 4).cast("long")


def bpe_counter(vocabulary: str, pattern: str = BPE_PATTERN):
    """A column function that counts the tokens of a byte-pair vocabulary (a file of base64 tokens with their ranks)."""
    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encoding = _bpe(vocabulary, pattern)
        return text.map(lambda t: None if t is None else len(encoding.encode_ordinary(t)))

    return count


@lru_cache
def _bpe(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_assignment(line: Column) -> tuple[Column, Column]:
    """Key and value at the first '=', or at the first ':' if there is no '=' with a value after it."""

    def at(mark: str) -> tuple[Column, Column, Column]:
        place = F.locate(mark, line)
        value = F.when(place > 0, F.substring(line, place + 1, F.char_length(line)))
        return F.when(place > 0, F.substring(line, F.lit(1), place - 1)), value, value.isNotNull() & (F.trim(F.regexp_replace(value, r"\s", " ")) != "")

    (k1, v1, ok1), (k2, v2, ok2) = at("="), at(":")
    return F.when(ok1, k1).when(ok2, k2), F.when(ok1, v1).when(ok2, v2)


def usd_to_micro(usd: Column) -> Column:
    """Integer millionths; null for negative or non-finite amounts."""
    return F.when((usd >= 0) & (usd < float("inf")) & ~F.isnan(usd), F.round(usd * 1_000_000).cast("long"))


def permille(part: Column, whole: Column) -> Column:
    """part * 1000 div whole, 0 where whole is 0."""
    return F.when(whole > 0, F.floor(part * 1000 / F.when(whole > 0, whole))).otherwise(0).cast("long")


def epoch_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_path(path: str) -> str | None:
    """Resolve '.', '..' and backslashes; None where it leaves the root."""
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def render_template(template: str, values: dict[str, str]) -> str:
    """{{name}} substitution; unknown names and an unterminated opening stay as they are."""
    return re.sub(r"\{\{(.*?)\}\}", lambda m: values.get(m[1].strip(), m[0]), template, flags=re.S)


def coerce_int(value: object) -> int | None:
    """Integers, and strings or floats with an integral value."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return int(number) if number.is_integer() else None
