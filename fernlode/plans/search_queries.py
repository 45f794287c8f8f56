"""Search queries over ``documents`` and ``pages``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.operators import index, search


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus: one root for each source, the id as the path."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("source").alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("language"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.lit("web").alias("root_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"), F.octet_length("html").cast("long").alias("size"))


_CORPUS = "c AS (SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents)"
_LINES = "l AS (SELECT root_id, rel_path, text, unnest(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END) AS line_text, generate_subscripts(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END, 1) AS line FROM c)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENTRIES = "e AS (SELECT 'web' AS root_id, regexp_replace(url, '^[a-z]+://', '') AS rel_path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)"


def _bm25_sql(terms: list[str]) -> str:
    many = len(terms) > 1
    stats = ", ".join(f"count(*) FILTER (WHERE list_contains(t, '{x}')) AS df{k}" for k, x in enumerate(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{x}')) AS tf{k}" for k, x in enumerate(terms))
    parts = " + ".join((f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * " if many else "") + f"(tf{k} * 2.2) / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    return f"""s AS (SELECT count(*) AS n, avg(greatest(len(t), 1)) AS avgdl, {stats} FROM c), f AS (SELECT root_id, rel_path, greatest(len(t), 1) AS dl, {tf} FROM c),
        b AS (SELECT root_id, rel_path, CAST(round(CAST(({parts}) AS DOUBLE) * 1000000) AS BIGINT) AS score FROM f, s WHERE {' + '.join(f'tf{k}' for k in range(len(terms)))} > 0)"""


def _indexed(spark: SparkSession, sf_dir: str, pattern: str, max_results: int | None) -> DataFrame:
    return search.content_search(None, pattern, max_results=max_results, index=index.build_index(documents(spark, sf_dir)))


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over an index that grew by a segment, lost files and had files replaced since it was built."""
    d = documents(spark, sf_dir)
    number = F.col("rel_path").cast("long") % 10
    first = index.build_index(d.filter(number < 7).withColumn("text", F.when(number == 3, "an old license").otherwise(F.col("text"))))
    second = index.update_index(first, d.filter((number >= 7) | (number == 3)), d.filter(number == 5))
    return search.content_search(None, "icens", max_results=None, index=second)


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_many(index.build_index(documents(spark, sf_dir)), ["mit license", "é", "ß", "in der", "qu", "erth", "no such text"], None)


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25_top(index.build_index(documents(spark, sf_dir)), ["the", "license", "que"], 50).files.select("root_id", "rel_path", "score")


QUERIES = {
    "content_search_bm25": lambda s, d: search.content_search(documents(s, d), "the in", max_results=50),
    "content_search_indexed": lambda s, d: _indexed(s, d, "the in", 50),
    "content_search_indexed_all": lambda s, d: _indexed(s, d, "license", None),
    "content_search_updated_index": _updated,
    "content_search_many": _many,
    "bm25_indexed": lambda s, d: index.bm25_of(index.build_index(documents(s, d)), ["the", "license", "que"]),
    "bm25_top_blocks": _top,
    "content_search_all_lines": lambda s, d: search.content_search(documents(s, d), "license", max_results=None),
    "content_search_whole_word": lambda s, d: search.content_search(documents(s, d), "la", whole_word=True, max_results=None),
    "bm25_scores": lambda s, d: search.bm25(documents(s, d), ["the", "license", "que"]),
    "bm25_single_term": lambda s, d: search.bm25(documents(s, d), ["apache"]),
    "regex_lines": lambda s, d: search.matching_lines(documents(s, d), search.Matcher(r"(\w+ ){2}[a-z]+ion", regex=True)),
    "tf_density_regex": lambda s, d: search.tf_density(documents(s, d), search.Matcher("[a-z]+tion", regex=True)),
    "match_files": lambda s, d: search.match_files(documents(s, d), "the"),
    "search_totals": lambda s, d: search.search_totals(documents(s, d), "der"),
    "line_context": lambda s, d: search.line_context(documents(s, d), "license", 2, 1).select("root_id", "rel_path", "line", F.explode("context").alias("c")).select("root_id", "rel_path", "line", F.col("c.line").alias("context_line"), F.col("c.text").alias("text")),
    "path_search_regex": lambda s, d: search.path_search(page_entries(s, d), "[0-9]+$", regex=True, max_results=None),
    "path_search_literal": lambda s, d: search.path_search(page_entries(s, d), "blog", max_results=None),
    "path_search_fuzzy": lambda s, d: search.path_search(page_entries(s, d), "eor5", max_results=None),
    "entry_filter_globs": lambda s, d: search.entry_filter(page_entries(s, d), include=["**/en/**", "blog.*/**"], exclude=["**/*5"]),
    "list_files": lambda s, d: search.list_files(page_entries(s, d), "Example.org", limit=None),
    "read_range": lambda s, d: search.read_range(documents(s, d), 2, 4),
    "scan_budget": lambda s, d: search.scan_budget(documents(s, d).select("root_id", "rel_path", "size"), 700, 1_000_000),
}

ORACLE_SQL = {
    "content_search_bm25": f"""WITH {_CORPUS}, {_LINES}, {_bm25_sql(['the', 'in'])},
        m AS (SELECT root_id, rel_path, CAST(line AS BIGINT) AS line, CAST(octet_length(encode(substr(line_text, 1, strpos({_FOLD.format('line_text')}, 'the in') - 1))) + 1 AS BIGINT) AS "column", substr(line_text, 1, 240) AS text,
                     row_number() OVER (PARTITION BY root_id, rel_path ORDER BY line) AS nth FROM l WHERE contains({_FOLD.format('line_text')}, 'the in'))
        SELECT m.root_id, m.rel_path, line, "column", coalesce(score, 0) AS score, text, nth FROM m LEFT JOIN b USING (root_id, rel_path) WHERE nth <= 17
        ORDER BY nth, score DESC, rel_path, root_id, line LIMIT 50""",
    "content_search_all_lines": f"""WITH {_CORPUS}, {_LINES}, {_bm25_sql(['license'])}
        SELECT l.root_id, l.rel_path, CAST(line AS BIGINT) AS line, CAST(octet_length(encode(substr(line_text, 1, strpos({_FOLD.format('line_text')}, 'license') - 1))) + 1 AS BIGINT) AS "column", coalesce(score, 0) AS score,
               substr(line_text, 1, 240) AS text, row_number() OVER (PARTITION BY l.root_id, l.rel_path ORDER BY line) AS nth
        FROM l LEFT JOIN b USING (root_id, rel_path) WHERE contains({_FOLD.format('line_text')}, 'license')""",
    "content_search_whole_word": f"""WITH {_CORPUS}, {_LINES}, g AS (SELECT root_id, rel_path, line_text, line, {_FOLD.format('line_text')} AS f FROM l),
        k AS (SELECT *, len(list_filter(regexp_split_to_array(f, '[^a-z0-9_]+'), lambda x: x = 'la')) AS n FROM g), s AS (SELECT root_id, rel_path, sum(n) AS hits, count(*) AS n_lines FROM k GROUP BY ALL),
        b AS (SELECT root_id, rel_path, CAST(round(hits / greatest(len(t), n_lines, 1) * 1000000) AS BIGINT) AS score FROM s JOIN c USING (root_id, rel_path) WHERE hits > 0)
        SELECT root_id, rel_path, CAST(line AS BIGINT) AS line, CAST(octet_length(encode(substr(line_text, 1, length(regexp_extract(f, '(?s)^((?:.*?[^a-z0-9_])??)la(?:[^a-z0-9_]|$)', 1))))) + 1 AS BIGINT) AS "column", coalesce(score, 0) AS score,
               substr(line_text, 1, 240) AS text, row_number() OVER (PARTITION BY root_id, rel_path ORDER BY line) AS nth FROM k LEFT JOIN b USING (root_id, rel_path) WHERE n > 0""",
    "line_context": f"""WITH {_CORPUS}, {_LINES}, h AS (SELECT root_id, rel_path, line FROM l WHERE contains({_FOLD.format('line_text')}, 'license'))
        SELECT h.root_id, h.rel_path, CAST(h.line AS BIGINT) AS line, CAST(l.line AS BIGINT) AS context_line, substr(l.line_text, 1, 240) AS text FROM h JOIN l ON l.root_id = h.root_id AND l.rel_path = h.rel_path AND l.line BETWEEN h.line - 2 AND h.line + 1""",
    "bm25_scores": f"WITH {_CORPUS}, {_bm25_sql(['the', 'license', 'que'])} SELECT * FROM b",
    "bm25_single_term": f"WITH {_CORPUS}, {_bm25_sql(['apache'])} SELECT * FROM b",
    "regex_lines": f"""WITH {_CORPUS}, {_LINES}
        SELECT root_id, rel_path, CAST(line AS BIGINT) AS line, CAST(octet_length(encode(regexp_extract(line_text, '(?s)^(.*?)(?:' || '(?i)([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+ ){{2}}[a-z]+ion' || ')', 1))) + 1 AS BIGINT) AS column,
            substr(line_text, 1, 240) AS text, CAST(len(regexp_extract_all(line_text, '(?i)([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+ ){{2}}[a-z]+ion')) AS BIGINT) AS occurrences FROM l WHERE regexp_matches(line_text, '(?i)([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+ ){{2}}[a-z]+ion')""",
    "tf_density_regex": f"""WITH {_CORPUS}, {_LINES}, h AS (SELECT root_id, rel_path, count(*) AS n, sum(len(regexp_extract_all(line_text, '(?i)[a-z]+tion'))) AS hits FROM l GROUP BY ALL)
        SELECT root_id, rel_path, CAST(round(hits / greatest(len(t), n, 1) * 1000000) AS BIGINT) AS score FROM h JOIN c USING (root_id, rel_path) WHERE hits > 0""",
    "match_files": f"""WITH {_CORPUS}, {_LINES} SELECT root_id, rel_path, count(*) AS count, CAST(sum((length(line_text) - length(replace({_FOLD.format('line_text')}, 'the', ''))) // 3) AS BIGINT) AS occurrences
        FROM l WHERE contains({_FOLD.format('line_text')}, 'the') GROUP BY ALL""",
    "search_totals": f"""WITH {_CORPUS}, {_LINES}, h AS (SELECT count(*) AS k, count(DISTINCT (root_id, rel_path)) AS f FROM l WHERE contains({_FOLD.format('line_text')}, 'der'))
        SELECT count(*) AS scanned_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS scanned_bytes, any_value(f) AS matching_files, any_value(k) AS matching_lines FROM c, h""",
    "path_search_regex": f"""WITH {_ENTRIES} SELECT root_id, rel_path, CAST(900000 - octet_length(encode(rel_path)) - 2 * (length(rel_path) - length(regexp_extract(rel_path, '[0-9]+$'))) AS BIGINT) AS score
        FROM e WHERE regexp_matches(rel_path, '[0-9]+$')""",
    "entry_filter_globs": f"""WITH {_ENTRIES} SELECT * FROM e WHERE (regexp_matches(rel_path, '^(.*/)?en/.*$') OR regexp_matches(rel_path, '^blog\\.[^/]*/.*$')) AND NOT regexp_matches(rel_path, '^(.*/)?[^/]*5$')""",
    "list_files": f"WITH {_ENTRIES}, k AS (SELECT * FROM e WHERE contains(lower(rel_path), 'example.org')) SELECT root_id, rel_path, size, (SELECT count(*) FROM k) AS total, false AS truncated FROM k",
    "read_range": """WITH c AS (SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, string_split(coalesce(text, ''), chr(10)) AS p, coalesce(text, '') AS text FROM documents),
        n AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN ends_with(text, chr(10)) THEN len(p) - 1 ELSE len(p) END AS total FROM c)
        SELECT root_id, rel_path, CASE WHEN least(4, total) < 2 THEN '' ELSE array_to_string(p[2:least(4, total)], chr(10)) || CASE WHEN total > 4 OR ends_with(text, chr(10)) THEN chr(10) ELSE '' END END AS text,
               CAST(2 AS BIGINT) AS first_line, CAST(least(4, total) AS BIGINT) AS last_line, CAST(total AS BIGINT) AS total_lines FROM n""",
    "scan_budget": """WITH e AS (SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents),
        r AS (SELECT *, row_number() OVER w AS k, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS bytes FROM e WINDOW w AS (ORDER BY rel_path, root_id))
        SELECT root_id, rel_path, size FROM r WHERE k <= 700 AND bytes <= 1000000""",
}
ORACLE_SQL |= {"content_search_indexed": ORACLE_SQL["content_search_bm25"], "content_search_indexed_all": ORACLE_SQL["content_search_all_lines"], "bm25_indexed": ORACLE_SQL["bm25_scores"]}
ORACLE_SQL["bm25_top_blocks"] = ORACLE_SQL["bm25_scores"] + " ORDER BY score DESC, rel_path, root_id LIMIT 50"


def _lines_sql(tables: str, pattern: str, score: str) -> str:
    fold = _FOLD.format("line_text")
    return f"""SELECT {pattern} AS pattern, l.root_id, l.rel_path, CAST(line AS BIGINT) AS line, CAST(octet_length(encode(substr(line_text, 1, strpos({fold}, {pattern}) - 1))) + 1 AS BIGINT) AS "column", {score} AS score,
        substr(line_text, 1, 240) AS text, row_number() OVER (PARTITION BY {pattern}, l.root_id, l.rel_path ORDER BY line) AS nth FROM {tables} WHERE contains({fold}, {pattern})"""


ORACLE_SQL["content_search_updated_index"] = f"""WITH {_CORPUS.replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 5)')}, {_LINES}, k AS ({_lines_sql("l", "'icens'", "CAST(0 AS BIGINT)")}) SELECT * EXCLUDE (pattern) FROM k"""
ORACLE_SQL["content_search_many"] = f"""WITH {_CORPUS}, {_LINES}, q(pattern, terms) AS (VALUES ('mit license', ['mit', 'license']), ('é', ['é']), ('ß', ['ß']), ('in der', ['in', 'der']), ('qu', ['qu']), ('erth', ['erth']), ('no such text', ['no', 'such', 'text'])),
    a AS (SELECT count(*) AS n, avg(greatest(len(t), 1)) AS avgdl FROM c), u AS (SELECT pattern, len(terms) AS many, unnest(terms) AS term, generate_subscripts(terms, 1) AS k FROM q),
    df AS (SELECT u.term, count(*) AS df FROM c, (SELECT DISTINCT term FROM u) u WHERE list_contains(t, u.term) GROUP BY 1),
    tf AS (SELECT root_id, rel_path, pattern, k, many, u.term, len(list_filter(t, lambda x: x = u.term)) AS tf, greatest(len(t), 1) AS dl FROM c, u WHERE list_contains(t, u.term)),
    b AS (SELECT root_id, rel_path, pattern, CAST(round(CAST(list_sum(list(CASE WHEN many > 1 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) ELSE 1 END * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ORDER BY k)) AS DOUBLE) * 1000000) AS BIGINT) AS score FROM tf JOIN df USING (term), a GROUP BY ALL),
    m AS ({_lines_sql("l, q", "q.pattern", "CAST(0 AS BIGINT)")}) SELECT m.* REPLACE (coalesce(b.score, 0) AS score) FROM m LEFT JOIN b USING (pattern, root_id, rel_path)"""


def _fuzzy_sql(pattern: str) -> str:
    """Every way to place the pattern's characters one after the other, with the best predecessor of each place by its distance."""
    return f"""WITH RECURSIVE {_ENTRIES}, h AS (SELECT root_id, rel_path, unnest(range(1, length(rel_path) + 1)) AS j FROM e),
        k AS (SELECT root_id, rel_path, j, lower(substr(rel_path, j, 1)) AS c, substr(rel_path, j, 1) AS x, CASE WHEN j = 1 THEN '/' ELSE substr(rel_path, j - 1, 1) END AS b FROM h),
        w AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[a-zA-Z0-9]') AND ascii(x) < 128 THEN 8 WHEN b = '/' OR b = chr(92) THEN 9 WHEN NOT regexp_matches(b, '[a-zA-Z0-9]') AND ascii(b) < 128 THEN 8
                     WHEN regexp_matches(b, '[a-z]') AND regexp_matches(x, '[A-Z]') OR NOT regexp_matches(b, '[0-9]') AND regexp_matches(x, '[0-9]') THEN 5 ELSE 0 END AS bonus FROM k),
        s AS (SELECT root_id, rel_path, 1 AS i, j, 16 + 2 * bonus AS v FROM w WHERE c = '{pattern[0]}' UNION ALL
              SELECT s.root_id, s.rel_path, s.i + 1, w.j, max(s.v + 16 + CASE WHEN w.j = s.j + 1 THEN greatest(w.bonus, 8) ELSE w.bonus - 2 - (w.j - s.j - 1) END)
              FROM s JOIN w ON w.root_id = s.root_id AND w.rel_path = s.rel_path AND w.j > s.j AND w.c = substr('{pattern}', s.i + 1, 1) WHERE s.i < {len(pattern)} GROUP BY s.root_id, s.rel_path, s.i, w.j),
        f AS (SELECT root_id, rel_path, greatest(max(v), 1) AS fuzzy FROM s WHERE i = {len(pattern)} GROUP BY 1, 2), o AS (SELECT root_id, rel_path, strpos(lower(rel_path), '{pattern}') AS p FROM e)
        SELECT root_id, rel_path, CAST(CASE WHEN p > 0 THEN 1000000 + fuzzy - octet_length(encode(rel_path)) - 2 * octet_length(encode(substr(rel_path, 1, p - 1))) + CASE WHEN ends_with(lower(rel_path), '{pattern}') THEN 4 ELSE 0 END ELSE fuzzy END AS BIGINT) AS score
        FROM o JOIN f USING (root_id, rel_path)"""


ORACLE_SQL["path_search_literal"], ORACLE_SQL["path_search_fuzzy"] = _fuzzy_sql("blog"), _fuzzy_sql("eor5")
