"""Content and path search over a corpus ``(root_id, rel_path, text)``.

Scores are integers scaled by 1e6.  Whole-corpus statistics take one aggregation of one row; lines are
only split for texts that match.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.functions.regex import line_hits, linear_pattern, may_hold
from fernlode.functions.text import ascii_lower, glob_regex, lines, normalized_doc_len, smart_case, tokenize_query, tokenize_text
from fernlode.operators import index as indexes
from fernlode.operators.index import SearchIndex, binary_text
from fernlode.storage import bound_batches

K1, B = 1.2, 0.75
PREVIEW_CHARS = 240
KEY = ["root_id", "rel_path"]


def _any_glob(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def entry_filter(entries: DataFrame, extensions: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Extension whitelist and any include glob (where set) and no exclude glob."""
    path = F.col("rel_path")
    out = entries
    if extensions:
        out = out.filter(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin([e.lstrip(".").lower() for e in extensions]))
    if include:
        out = out.filter(_any_glob(path, include))
    if exclude:
        out = out.filter(~_any_glob(path, exclude))
    return out


def scan_budget(entries: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Entries in snapshot order before the first that would pass either bound.

    Only the first ``max_files`` of the order can be among them, so the running sum is over that many rows.
    """
    first = entries.orderBy("rel_path", "root_id").limit(max_files)
    upto = Window.orderBy("rel_path", "root_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_bytes", F.sum("size").over(upto)).filter(F.col("_bytes") <= max_bytes).drop("_bytes")


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")


def path_scope(entries: DataFrame, path: str, roots: dict[str, str] | None = None) -> DataFrame:
    """Exact path or everything below it; an empty path matches nothing.

    Where no entry has the path as it stands, its first part may be a root's id, or the base name of just one of
    ``roots`` (id to path), and the rest the path in that root.
    """
    p = path.rstrip("/")
    if not p:
        return entries.filter(F.lit(False))
    prefix, _, rest = p.partition("/")
    named = [i for i, full in (roots or {}).items() if full.rstrip("/").rpartition("/")[2] == prefix]
    at, rel = F.col("root_id").isin([prefix, *(named if len(named) == 1 else [])]) & F.lit(bool(rest)), F.col("rel_path")
    here, below = rel == p, rel.startswith(p + "/")
    seen = entries.agg(F.max(here).alias("_here"), F.max(below).alias("_below"))
    rows = entries.crossJoin(F.broadcast(seen))  # one row
    return rows.filter(here | below | ~F.col("_here") & at & (rel == rest) | ~F.col("_below") & at & rel.startswith(rest + "/")).drop("_here", "_below")


class Matcher:
    """Line predicate, first byte column and number of matches of a literal; ``hits`` of a literal or a regular expression."""

    def __init__(self, pattern: str, regex: bool = False, whole_word: bool = False):
        self.pattern, self.regex, self.whole_word = pattern, regex, whole_word
        self.case = smart_case(pattern)
        body = re.sub(r"([\\.+*?()|{}^$\[\]#-])", r"\\\1", pattern)
        self.java = ("" if self.case else "(?i)") + f"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
        if regex:
            linear_pattern(pattern)

    def may_match(self, text: Column) -> Column:
        """False only for texts without a match: a test before they are split."""
        return may_hold(text, self.pattern, self.case) if self.regex else self.matches(text)

    def hits(self, own: Column) -> Column:
        """Of an array of lines those that match: k (from 0), at (bytes before the first match), n (matches)."""
        if self.regex:
            return line_hits(own, self.pattern, self.case, self.whole_word)
        found = F.transform(own, lambda x, k: F.when(self.matches(x), F.struct(k.alias("k"), (self.column(x) - 1).alias("at"), self.occurrences(x).cast("long").alias("n"))))
        return F.array_compact(found)

    def _plain(self, c: Column) -> tuple[Column, str]:
        return (c, self.pattern) if self.case else (ascii_lower(c), self.pattern.translate({k: k + 32 for k in range(65, 91)}))

    def matches(self, c: Column) -> Column:
        if self.whole_word:
            return c.rlike(self.java)
        text, pattern = self._plain(c)
        return text.contains(pattern)

    def first_char(self, c: Column) -> Column:
        """Characters before the first match."""
        if self.whole_word:
            return F.char_length(F.split(c, self.java, 2)[0])
        text, pattern = self._plain(c)
        return F.locate(pattern, text) - 1

    def column(self, c: Column) -> Column:
        """1-based byte column of the first match."""
        return (F.octet_length(F.substring(c, F.lit(1), self.first_char(c).cast("int"))) + 1).cast("long")

    def occurrences(self, c: Column) -> Column:
        if self.whole_word:
            return F.regexp_count(c, F.lit(self.java))
        text, pattern = self._plain(c)
        return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")


def corpus_statistics(corpus: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """One row: documents, average length, and the document frequency of each term, over all texts."""
    tokens = corpus.select(tokenize_text(F.col("text"), case_sensitive).alias("_t"))
    return tokens.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size("_t"), F.lit(1))).alias("avgdl"), *[F.count_if(F.array_contains("_t", t)).alias(f"df{k}") for k, t in enumerate(terms)])


def _times(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(corpus: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """(root_id, rel_path, score): BM25 scaled by 1e6; a single term has no inverse document frequency."""
    stats = corpus_statistics(corpus, terms, case_sensitive)
    own = corpus.select(*KEY, tokenize_text(F.col("text"), case_sensitive).alias("_t"))
    own = own.select(*KEY, F.greatest(F.size("_t"), F.lit(1)).alias("dl"), *[_times("_t", t).alias(f"tf{k}") for k, t in enumerate(terms)])
    joined = own.filter(" + ".join(f"tf{k}" for k in range(len(terms))) + " > 0").crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for k in range(len(terms)):
        idf = _idf(F.col("n"), F.col(f"df{k}")) if len(terms) > 1 else F.lit(1.0)
        total = total + idf * _saturated(F.col(f"tf{k}"), F.col("dl"), F.col("avgdl"))
    return joined.select(*KEY, F.round(total * 1_000_000).cast("long").alias("score"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def tf_density(corpus: DataFrame, matcher: Matcher) -> DataFrame:
    """(root_id, rel_path, score): matches by max(tokens, lines, 1), scaled by 1e6."""
    own = _hit_lines(corpus, matcher, normalized_doc_len(F.size(tokenize_text(F.col("text"), matcher.case)), F.size(lines(F.col("text")))).alias("_n"))
    total = F.aggregate("_h", F.lit(0).cast("long"), lambda s, h: s + h["n"])
    return own.select(*KEY, F.round(total / F.col("_n") * 1_000_000).cast("long").alias("score"))


def _hit_lines(corpus: DataFrame, matcher: Matcher, *more: Column) -> DataFrame:
    """The texts with a matching line: their lines ``_l`` and the hits ``_h`` among them. Texts that cannot match are dropped before they are split."""
    bound_batches(corpus.sparkSession)
    own = corpus.filter(matcher.may_match(F.col("text"))).select(*KEY, lines(F.col("text")).alias("_l"), *more)
    return own.withColumn("_h", matcher.hits(F.col("_l"))).filter(F.size("_h") > 0)


def matching_lines(corpus: DataFrame, matcher: Matcher) -> DataFrame:
    """One row per matching line: line, byte column, preview, occurrences. Binary texts are passed over."""
    own = _hit_lines(corpus.filter(~binary_text(F.col("text"))), matcher)
    shown = F.transform("_h", lambda h: F.struct((h["k"] + 1).cast("long").alias("line"), (h["at"] + 1).cast("long").alias("column"), F.substring(F.get(F.col("_l"), h["k"]), 1, PREVIEW_CHARS).alias("text"), h["n"].alias("occurrences")))
    return own.select(*KEY, F.explode(shown).alias("m")).select(*KEY, "m.*")


RESULT = [*KEY, "line", "column", "score", "text", "nth"]


def file_cap(max_results: int) -> int:
    """Lines that a file may give to a limited result."""
    return min(max(-(-max_results // 3), 1), 20)


def _round_robin(rows: DataFrame, max_results: int) -> DataFrame:
    return rows.filter(F.col("nth") <= file_cap(max_results)).orderBy("nth", F.desc("score"), "rel_path", "root_id", "line").limit(max(max_results, 1))


def content_search(corpus: DataFrame | None, pattern: str, regex: bool = False, whole_word: bool = False, max_results: int | None = 50, index: SearchIndex | None = None) -> DataFrame:
    """Ranked matching lines, taken round-robin from the files: each file's first line in rank order, then the second, ...

    ``max_results`` None returns every line without the cap for each file.  With an ``index`` of the corpus, a literal
    search without capitals reads its files, texts and scores from there; other searches need the corpus.
    """
    matcher = Matcher(pattern, regex, whole_word)
    if index is not None and not (regex or whole_word or matcher.case):
        return _indexed_search(index, pattern, max_results)
    corpus = corpus.filter(~binary_text(F.col("text")))
    terms = tokenize_query(pattern, matcher.case)
    scores = tf_density(corpus, matcher) if regex or whole_word or not terms else bm25(corpus, terms, matcher.case)
    rows = matching_lines(corpus, matcher).join(scores, KEY, "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("line")).cast("long")).select(*RESULT)
    return rows if max_results is None else _round_robin(rows, max_results)


def search_many(index: SearchIndex, patterns: list[str], max_results: int | None = 50) -> DataFrame:
    """The rows of ``content_search`` for several literals without capitals, with the pattern, in one pass over the index."""
    folded = [p.translate({k: k + 32 for k in range(65, 91)}) for p in patterns]
    if any(smart_case(p) for p in patterns):
        raise ValueError("search_many takes literals without capitals")
    if not patterns:
        raise ValueError("no patterns")
    files = indexes.matching_files(index, folded)
    name = F.get(F.array(*[F.lit(p) for p in folded]), F.col("p"))
    found = _lines_of(files.withColumn("pattern", name))
    if max_results is None:
        return found.select("pattern", *RESULT)
    order = F.row_number().over(Window.partitionBy("pattern").orderBy("nth", F.desc("score"), "rel_path", "root_id", "line"))
    return found.filter(F.col("nth") <= file_cap(max_results)).withColumn("_r", order).filter(F.col("_r") <= max(max_results, 1)).select("pattern", *RESULT)


def _lines_of(files: DataFrame) -> DataFrame:
    """(pattern, root_id, rel_path, text, score) to the rows of RESULT: the file's lines with the literal; nth comes from the array of a file's lines."""
    hit = files.filter(F.contains(ascii_lower(F.col("text")), F.col("pattern")))
    at = lambda x: F.position(F.col("pattern"), ascii_lower(x))
    own = F.transform(lines(F.col("text")), lambda x, k: F.struct((k + 1).cast("long").alias("line"), x.alias("text"), at(x).alias("at")))
    rows = hit.select("pattern", *KEY, "score", F.posexplode(F.filter(own, lambda x: x["at"] > 0)).alias("k", "l"))
    column = F.octet_length(F.substring(F.col("l.text"), F.lit(1), F.col("l.at") - 1)) + 1
    return rows.select("pattern", *KEY, "l.line", column.cast("long").alias("column"), "score", F.substring("l.text", 1, PREVIEW_CHARS).alias("text"), (F.col("k") + 1).cast("long").alias("nth"))


def _indexed_search(index: SearchIndex, pattern: str, max_results: int | None) -> DataFrame:
    """Where many files hold the grams of a limited search with terms, the best files first, until enough of them match; else all candidates."""
    terms = tokenize_query(pattern)
    if max_results is not None and terms and indexes.many_candidates(index, pattern, 8 * max_results):
        texts = lambda chunks: index.table("files").select("chunk", "at", "text").filter(F.col("chunk").isin(chunks))
        holds = F.contains(ascii_lower(F.col("text")), F.lit(pattern))
        top = indexes.bm25_top(index, terms, max(max_results, 1), lambda found, chunks: found.join(texts(chunks).filter(holds), ["chunk", "at"]).drop("text"))
        if top.found >= max_results:
            files = top.files.join(texts(top.chunks), ["chunk", "at"]).withColumn("pattern", F.lit(pattern))
            return _round_robin(_lines_of(files).filter("nth = 1").select(*RESULT), max_results)
    return search_many(index, [pattern], max_results).drop("pattern")


def match_files(corpus: DataFrame, pattern: str, regex: bool = False, whole_word: bool = False) -> DataFrame:
    """Matching lines of each file (count mode)."""
    return matching_lines(corpus, Matcher(pattern, regex, whole_word)).groupBy(*KEY).agg(F.count("*").alias("count"), F.sum("occurrences").cast("long").alias("occurrences"))


def search_totals(corpus: DataFrame, pattern: str) -> DataFrame:
    """Scanned files and bytes, matching files and lines."""
    m = Matcher(pattern)
    counts = F.size(F.filter(lines(F.col("text")), m.matches))
    return corpus.agg(F.count("*").alias("scanned_files"), F.sum(F.octet_length("text").cast("long")).alias("scanned_bytes"), F.count_if(counts > 0).alias("matching_files"), F.sum(counts.cast("long")).alias("matching_lines"))


def line_context(corpus: DataFrame, pattern: str, before: int = 2, after: int = 2, regex: bool = False) -> DataFrame:
    """Matching lines with their neighbours [line - before, line + after], cut to the file; each line previewed."""
    # The context is a slice of the text's own line array: no window, no shuffle.
    own = _hit_lines(corpus.filter(~binary_text(F.col("text"))), Matcher(pattern, regex))
    first = lambda h: F.greatest(h["k"] - before, F.lit(0))
    around = lambda h: F.slice(F.col("_l"), first(h) + 1, h["k"] + after + 1 - first(h))
    context = lambda h: F.transform(around(h), lambda x, j: F.struct((first(h) + j + 1).cast("long").alias("line"), F.substring(x, 1, PREVIEW_CHARS).alias("text")))
    rows = own.select(*KEY, F.explode(F.transform("_h", lambda h: F.struct((h["k"] + 1).cast("long").alias("line"), context(h).alias("context")))).alias("m"))
    return rows.select(*KEY, "m.line", "m.context")


#: A matched character, a gap's first and further characters, and the bonuses of the place that a character is matched at.
MATCH, GAP_START, GAP_NEXT = 16, 3, 1
AFTER_SLASH, BOUNDARY, CAMEL, IN_A_ROW = 9, 8, 5, 8
LOWEST = -(10**9)


def _place_bonus(codes: np.ndarray) -> np.ndarray:
    """(rows x places) the bonus of each place: a path part's start, a word's start, a hump or a number's start."""
    kinds = np.zeros(codes.shape, np.int8)  # 0 other, 1 slash, 2 small letter, 3 capital, 4 digit
    kinds[(codes == 47) | (codes == 92)] = 1
    kinds[(codes >= 97) & (codes <= 122) | (codes > 127)] = 2
    kinds[(codes >= 65) & (codes <= 90)] = 3
    kinds[(codes >= 48) & (codes <= 57)] = 4
    before = np.ones(codes.shape, np.int8)
    before[:, 1:] = kinds[:, :-1]
    word = kinds >= 2
    out = np.zeros(codes.shape, np.int64)
    out[word & (before == 2) & (kinds == 3) | word & (before != 4) & (kinds == 4)] = CAMEL
    out[word & (before == 0) | ~word] = BOUNDARY
    out[word & (before == 1)] = AFTER_SLASH
    return out


def fuzzy_scores(paths: list[str], pattern: str, case: bool) -> np.ndarray:
    """The best affine-gap alignment of the pattern as a subsequence of each path; 0 where it is none, and 1 at least where it is.

    Two rows of a dynamic program over the places, for all paths at once: the best score with the pattern so far ending at a
    place, and the best one that ended before it, less its gap.
    """
    fold = lambda t: t if case else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    n, width = len(paths), max((len(p) for p in paths), default=0)
    codes, low = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for k, p in enumerate(paths):
        codes[k, : len(p)] = [ord(c) for c in p]
        low[k, : len(p)] = [ord(c) for c in fold(p)]
    bonus = _place_bonus(codes)
    ends: np.ndarray | None = None
    for c in fold(pattern):
        hit = low == ord(c)
        if ends is None:
            ends = np.where(hit, MATCH + 2 * bonus, LOWEST)
            continue
        new, gap = np.full((n, width), LOWEST, np.int64), np.full(n, LOWEST, np.int64)
        for j in range(1, width):
            row = np.maximum(ends[:, j - 1] + np.maximum(bonus[:, j], IN_A_ROW), gap + bonus[:, j])
            new[:, j] = np.where(hit[:, j] & (row > LOWEST // 2), row + MATCH, LOWEST)
            gap = np.maximum(ends[:, j - 1] - GAP_START, gap - GAP_NEXT)
        ends = new
    best = ends.max(axis=1) if ends is not None and width else np.full(n, LOWEST)
    return np.where(best > LOWEST // 2, np.maximum(best, 1), 0)


def fuzzy_score(path: Column, pattern: str, case: bool = False) -> Column:
    """``fuzzy_scores`` as a column, for the paths that hold the pattern's characters in order; 0 for others."""

    @F.arrow_udf("long")
    def scores(column: pa.Array) -> pa.Array:
        own = column.to_pylist()
        known = [p for p in own if p is not None]
        found = iter(fuzzy_scores(known, pattern, case).tolist())
        return pa.array([0 if p is None else next(found) for p in own], pa.int64())

    chars = [re.sub(r"([\\.+*?()|{}^$\[\]#-])", r"\\\1", c) for c in pattern]
    inside = path.rlike(("(?s)" if case else "(?isu)") + ".*?".join(chars))
    return F.coalesce(scores(F.when(inside, path)), F.lit(0))


def path_search(entries: DataFrame, pattern: str, regex: bool = False, max_results: int | None = 50) -> DataFrame:
    """Paths by score; lengths and places in bytes. Regex 900000 - len - 2 start; literal 1000000 + fuzzy - len - 2 start (+4 at the end); else fuzzy alone."""
    path, m = F.col("rel_path"), Matcher(pattern, regex)
    length = F.octet_length(path)
    if not pattern:
        score = F.lit(0)
    elif regex:
        bound_batches(entries.sparkSession)
        entries = entries.filter(m.may_match(path)).withColumn("_h", m.hits(F.array(path)))
        score = F.when(F.size("_h") > 0, 900_000 - length - 2 * F.get("_h", F.lit(0))["at"])
    else:
        start = m.column(path) - 1
        text, low = m._plain(path)
        fuzzy = fuzzy_score(path, pattern, m.case)
        score = F.when(m.matches(path), 1_000_000 + fuzzy - length - 2 * start + F.when(text.endswith(low), 4).otherwise(0)).when(fuzzy > 0, fuzzy)
    out = entries.select(*KEY, score.cast("long").alias("score")).filter("score IS NOT NULL")
    return out if max_results is None else out.orderBy(F.desc("score"), "rel_path", "root_id").limit(max(max_results, 1))


def list_files(entries: DataFrame, query: str | None = None, limit: int | None = 4000) -> DataFrame:
    """Paths that hold the query (any case), in order, with the total before the limit and whether that cut them."""
    rows = entries if not query else entries.filter(F.lower("rel_path").contains(query.lower()))
    total = rows.agg(F.count("*").alias("total"))
    kept = rows if limit is None else rows.orderBy("rel_path", "root_id").limit(limit)
    cut = F.lit(False) if limit is None else F.col("total") > limit
    return kept.select(*KEY, "size").crossJoin(F.broadcast(total)).withColumn("truncated", cut)  # one row


def read_range(corpus: DataFrame, start_line: int | None = None, end_line: int | None = None, limit: int | None = None) -> DataFrame:
    """Lines start..end with their terminators; ``limit`` overrides the end; clamped to the file."""
    first = max(start_line or 1, 1)
    own = F.regexp_extract_all("text", F.lit("(?s)[^\n]*\n|[^\n]+\\z"), 0)
    rows = corpus.select(*KEY, own.alias("_l")).withColumn("total_lines", F.size("_l").cast("long"))
    last = F.least(F.lit(first + limit - 1) if limit is not None else F.lit(end_line) if end_line is not None else F.col("total_lines"), F.col("total_lines"))
    text = F.array_join(F.filter("_l", lambda x, k: (k + 1 >= first) & (k + 1 <= last)), "")
    return rows.select(*KEY, text.alias("text"), F.lit(first).cast("long").alias("first_line"), last.cast("long").alias("last_line"), "total_lines")


def hashline_view(corpus: DataFrame) -> DataFrame:
    """[path#tag] and one numbered row for each line."""
    from fernlode.functions.hashing import content_tag

    numbered = F.transform(F.split("text", "\n"), lambda x, k: F.concat((k + 1).cast("string"), F.lit(":"), x))
    head = F.concat(F.lit("["), F.col("rel_path"), F.lit("#"), content_tag("text"), F.lit("]"))
    return corpus.select(*KEY, F.array_join(F.concat(F.array(head), numbered), "\n").alias("view"))


def checked_pattern(_spark: SparkSession, pattern: str, regex: bool, literal_fallback: bool = False) -> tuple[bool, list[str]]:
    """(whether the pattern is a regular expression, diagnostics): one that does not compile is an error, or a literal with a note."""
    if not regex:
        return False, []
    try:
        linear_pattern(pattern)
    except ValueError:
        if not literal_fallback:
            raise
        return False, [f"invalid regular expression, searched as a literal: {pattern}"]
    return True, []


def display_path(rows: DataFrame, roots: DataFrame, path: str = "rel_path") -> DataFrame:
    """rows with display_path: the root's base name before the path; a path of an unknown root stays. roots(root_id, root_path) is a short list."""
    name = F.regexp_extract(F.regexp_replace("root_path", "/+$", ""), "([^/]*)$", 1)
    joined = rows.join(F.broadcast(roots.select("root_id", name.alias("_root"))), "root_id", "left")
    shown = F.when(F.col("_root").isNull(), F.col(path)).when(F.col(path) == "", F.col("_root")).otherwise(F.concat("_root", F.lit("/"), path))
    return joined.withColumn("display_path", shown).drop("_root")


def top_content_files(hits: DataFrame, limit: int = 5) -> DataFrame:
    """The files with the most matching lines; none if fewer than two files match."""
    counts = hits.groupBy(*KEY).agg(F.count("*").alias("lines"))
    several = counts.agg((F.count("*") >= 2).alias("_several"))
    top = counts.orderBy(F.desc("lines"), "rel_path", "root_id").limit(limit)
    return top.crossJoin(F.broadcast(several)).filter("_several").drop("_several")  # one row


def code_scope(rows: DataFrame, paths: list[str], path: str = "rel_path") -> DataFrame:
    """Rows at one of the paths or below it; no paths means all rows."""
    hit = F.lit(not paths)
    for p in paths:
        hit = hit | (F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/")
    return rows.filter(hit)


def search_report(corpus: DataFrame, pattern: str, max_results: int = 50) -> DataFrame:
    """One row: scanned files and bytes, binary files passed over, matching files and lines, lines returned under the limits, and lines left out."""
    m = Matcher(pattern)
    binary = binary_text(F.col("text"))
    counts = F.when(binary, 0).otherwise(F.size(F.filter(lines(F.col("text")), m.matches))).cast("long")
    cap = min(max(-(-max_results // 3), 1), 20)
    sums = corpus.agg(
        F.count_if(~binary).alias("scanned_files"), F.coalesce(F.sum(F.when(~binary, F.octet_length("text").cast("long"))), F.lit(0)).alias("scanned_bytes"), F.count_if(binary).alias("binary_skipped"),
        F.count_if(counts > 0).alias("matching_files"), F.coalesce(F.sum(counts), F.lit(0)).alias("matching_lines"), F.coalesce(F.sum(F.least(counts, F.lit(cap))), F.lit(0)).alias("_shown"),
    )
    returned = F.least("_shown", F.lit(max(max_results, 1)).cast("long"))
    return sums.withColumn("returned", returned).withColumn("omitted", F.col("matching_lines") - returned).drop("_shown")
