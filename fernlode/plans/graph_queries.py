"""Graph, navigation, search and context queries over the driver's tables, with their DuckDB twins.

Documents stand for source files: the first word of a line defines a symbol that spans to the next one, and
all longer words are references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.functions.text import lines
from fernlode.operators import context, graph, search
from fernlode.plans.search_queries import documents, page_entries


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("rel_path").alias("path"), F.posexplode(lines(F.col("text"))).alias("k", "text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("path", (F.col("k") + 1).cast("long").alias("line"), F.lower(F.regexp_extract("text", "^([A-Za-z]{3,})", 1)).alias("name"), F.substring("text", 1, 40).alias("signature"), F.char_length("text").alias("n")).filter("name <> ''")
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    kind = F.when(F.col("line") % 3 == 0, "struct").otherwise("function")
    return rows.select("path", F.lit("rust").alias("language"), kind.alias("kind"), "name", "line", F.lit(1).cast("long").alias("column"), F.col("line").alias("start_line"), (F.coalesce(after, F.col("line") + 50) - 1).alias("end_line"), "signature")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _lines(spark, sf_dir).select("path", (F.col("k") + 1).cast("long").alias("line"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("column", "name"))
    return words.select("path", F.lit("rust").alias("language"), F.lit("call").alias("kind"), "name", "line", F.col("column").cast("long").alias("column"))


def nested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of four languages whose spans hold each other, from one line to a million, with ties in width and line."""
    d = documents(spark, sf_dir).select(F.col("rel_path").alias("path"), "language", F.posexplode(lines(F.col("text"))).alias("k", "text"))
    word = F.lower(F.regexp_extract("text", "^([A-Za-z]{3,})", 1))
    line = (F.col("k") + 1).cast("long")
    reach = F.when(line % 11 == 0, 1_000_000).when(line % 5 == 0, 700).when(line % 5 == 1, 0).when(line % 5 == 2, 12).otherwise(4)
    rows = d.select("path", _language().alias("language"), word.alias("name"), line.alias("line"), (line + reach).alias("end_line")).filter("name <> ''")
    both = F.array(F.struct("name", F.lit(3).alias("column")), F.when(F.col("line") % 4 == 0, F.struct(F.reverse("name").alias("name"), F.lit(2).alias("column"))))
    rows = rows.select("path", "language", "line", "end_line", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("s"))
    kind = F.when(F.col("line") % 3 == 0, "struct").when(F.col("line") % 3 == 1, "enum").otherwise("function")
    return rows.select("path", "language", kind.alias("kind"), "s.name", "line", F.col("s.column").cast("long").alias("column"), F.col("line").alias("start_line"), "end_line", F.lit("").alias("signature"))


def nested_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("rel_path").alias("path"), "language", F.posexplode(lines(F.col("text"))).alias("k", "text"))
    words = d.select("path", _language().alias("language"), (F.col("k") + 1).cast("long").alias("line"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("column", "name"))
    return words.select("path", "language", F.when(F.char_length("name") % 2 == 1, "type").otherwise("call").alias("kind"), "name", "line", F.col("column").cast("long").alias("column"), F.lit(None).cast("string").alias("import_path"))


def _language() -> Column:
    return F.when(F.col("language") == "en", "rust").when(F.col("language") == "de", "python").when(F.col("language") == "fr", "typescript").otherwise("tsx")


_N = """nd AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'en' THEN 'rust' WHEN 'de' THEN 'python' ELSE 'javascript' END AS family, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n$', '') AS text FROM documents WHERE coalesce(text, '') <> ''),
    nl AS (SELECT path, family, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM nd),
    n0 AS (SELECT path, family, line, lower(regexp_extract(text, '^([A-Za-z]{3,})', 1)) AS name, line + CASE WHEN line % 11 = 0 THEN 1000000 WHEN line % 5 = 0 THEN 700 WHEN line % 5 = 1 THEN 0 WHEN line % 5 = 2 THEN 12 ELSE 4 END AS end_line, ['enum', 'function', 'struct'][(line + 2) % 3 + 1] AS kind FROM nl),
    ns AS (SELECT path, family, line, end_line, kind, name, 3 AS "column" FROM n0 WHERE name <> '' UNION ALL SELECT path, family, line, end_line, kind, reverse(name), 2 FROM n0 WHERE name <> '' AND line % 4 = 0),
    nw AS (SELECT path, family, line, regexp_extract_all(lower(text), '[a-z]{4,}') AS ws FROM nl),
    nr AS (SELECT path, family, line, unnest(ws) AS name, unnest(range(len(ws))) AS "column" FROM nw)"""
_STOPPED = " OR ".join("family = '{}' AND nr.name IN ({})".format(f, ", ".join(f"'{x}'" for x in names)) for f, names in graph.STOP_NAMES.items())
_N_EDGES = f"""{_N}, ndf AS (SELECT DISTINCT family, name, path FROM ns), nfl AS (SELECT family, count(DISTINCT path) AS files FROM ns GROUP BY 1),
    npr AS (SELECT family, name FROM ndf JOIN nfl USING (family) GROUP BY family, name, files HAVING count(*) >= 4 AND count(*) * 4 > files), ndk AS (SELECT * FROM ndf WHERE (family, name) NOT IN (SELECT (family, name) FROM npr)),
    ne AS (SELECT nr.path AS src, ndk.path AS dst, CAST(count(*) AS DOUBLE) AS weight FROM nr JOIN ndk USING (family, name) WHERE nr.path <> ndk.path AND NOT ({_STOPPED}) GROUP BY ALL)"""
_L = """d AS (SELECT CAST(doc_id AS VARCHAR) AS path, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n$', '') AS text FROM documents WHERE coalesce(text, '') <> ''),
    l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
    s0 AS (SELECT path, line, lower(regexp_extract(text, '^([A-Za-z]{3,})', 1)) AS name FROM l),
    s AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line), line + 50) - 1 AS end_line, CASE WHEN line % 3 = 0 THEN 'struct' ELSE 'function' END AS kind FROM s0 WHERE name <> ''),
    w AS (SELECT path, line, regexp_extract_all(lower(text), '[a-z]{6,}') AS ws FROM l),
    r AS (SELECT path, line, unnest(ws) AS name, unnest(range(len(ws))) AS "column" FROM w)"""
# The stop words of the queries' language, written out for the twins.
_STOP = ", ".join(
    f"'{x}'"
    for x in "Self abstract as async await become box break const continue crate do dyn else enum extern false final fn for if impl in let loop macro match mod move mut override priv pub ref return self static struct super trait true try type typeof unsafe unsized use virtual where while yield Result Option Some None Ok".split()
)
_DEFS = f"""{_L}, df AS (SELECT DISTINCT name, path FROM s), nf AS (SELECT count(DISTINCT path) AS files FROM s), pr AS (SELECT name FROM df, nf GROUP BY name, files HAVING count(*) >= 4 AND count(*) * 4 > files),
    dk AS (SELECT * FROM df WHERE name NOT IN (SELECT name FROM pr)),
    e AS (SELECT r.path AS src, dk.path AS dst, CAST(count(*) AS DOUBLE) AS weight FROM r JOIN dk USING (name) WHERE r.path <> dk.path AND r.name NOT IN ({_STOP}) GROUP BY ALL)"""
_ENC = """en AS (SELECT r.path, r.name AS ref_name, r.line AS ref_line, r."column" AS ref_column, s.name AS symbol, s.line, s.kind FROM r JOIN s ON s.path = r.path AND r.line BETWEEN s.line AND s.end_line)"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from a user to the one whose event comes next within the same 100 events, and one to each type of event, which leads nowhere."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 100).alias("g"))
    after = F.lead("user_id").over(Window.partitionBy("g").orderBy("event_id"))
    next_user = e.select(F.col("user_id").cast("string").alias("src"), after.cast("string").alias("dst")).filter("dst IS NOT NULL AND src <> dst")
    pairs = next_user.unionByName(e.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")))
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


_TRANSITIONS = """t AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS dst, event_type, value FROM events),
    u AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM t WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT CAST(src AS VARCHAR), event_type FROM t),
    g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM u GROUP BY ALL),
    n AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS node FROM events UNION SELECT DISTINCT event_type FROM events), z AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS node FROM events WHERE event_type = 'signup' AND value > 90)"""


def _rank_sql(tables: str, columns: str) -> str:
    """Ranks over the tables g (src, dst, weight), n (nodes) and z (seeds)."""
    steps = ["x0 AS (SELECT node, p, dangling, p AS rank FROM b)"]
    for k in range(1, graph.ITERATIONS + 1):
        steps.append(f"""x{k} AS MATERIALIZED (SELECT b.node, b.p, b.dangling, 0.15 * b.p + 0.85 * (coalesce(i.got, 0) + (SELECT coalesce(sum(rank), 0) FROM x{k - 1} WHERE dangling) * b.p) AS rank
            FROM b LEFT JOIN (SELECT h.dst AS node, sum(x.rank * h.share) AS got FROM h JOIN x{k - 1} x ON x.node = h.src GROUP BY 1) i USING (node))""")
    return f"""WITH {tables}, o AS (SELECT src, sum(weight) AS total FROM g GROUP BY 1), h AS MATERIALIZED (SELECT src, dst, weight / total AS share FROM g JOIN o USING (src)),
        b AS MATERIALIZED (SELECT node, CASE WHEN node IN (SELECT node FROM z) THEN 1.0 / (SELECT count(*) FROM z) ELSE 0 END AS p, o.src IS NULL AS dangling FROM n LEFT JOIN o ON o.src = node), {", ".join(steps)} SELECT {columns} FROM x{graph.ITERATIONS}"""


def _pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nodes = events.select(F.explode(F.array(F.col("user_id").cast("string"), "event_type")).alias("node")).distinct()
    seeds = events.filter("event_type = 'signup' AND value > 90").select(F.col("user_id").cast("string").alias("node")).distinct()
    return graph.pagerank(_transitions(spark, sf_dir), nodes, seeds).select("node", F.round(F.col("rank") * 100_000_000).cast("long").alias("score"))


def _part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("signature"), F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"), F.concat(F.lit("part/"), F.col("p_partkey")).alias("display_path"), F.col("p_partkey").alias("line"))


def _hits(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    return search.matching_lines(documents(spark, sf_dir), search.Matcher(word))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    hits = search.content_search(d, "license", max_results=None).select(F.col("rel_path").alias("path"), "score")
    paths = d.select(F.col("rel_path").alias("path"), (F.char_length("rel_path") * 100).alias("score"))
    ranks = d.select(F.col("rel_path").alias("path"), F.col("size").alias("rank"))
    return context.fuse(hits, paths, ranks, "12 7").select("path", F.round(F.col("fused") * 1_000_000).cast("long").alias("fused"))


_FIELD = {"name": 80, "kind": 24, "signature": 16, "display_path": 4, "path": 4}


def _field_sql(term: str, fields: dict[str, int] = _FIELD) -> str:
    tokens = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
    return " + ".join(f"CASE WHEN lower({f}) = '{term}' THEN {4 * w} WHEN list_contains({tokens.format(f)}, '{term}') THEN {2 * w} WHEN len(list_filter({tokens.format(f)}, lambda x: starts_with(x, '{term}'))) > 0 THEN {w} WHEN contains(lower({f}), '{term}') THEN {w // 2} ELSE 0 END" for f, w in fields.items())


QUERIES = {
    "reference_edges": lambda s, d: graph.reference_edges(refs(s, d), symbols(s, d)),
    "graph_counters": lambda s, d: graph.reference_counters(refs(s, d), symbols(s, d)),
    "language_files": lambda s, d: graph.language_files(documents(s, d).select(F.col("rel_path").alias("path"), "language")),
    "pagerank": _pagerank,
    "enclosing_symbols": lambda s, d: graph.enclosing_symbols(refs(s, d), symbols(s, d)),
    "enclosing_symbols_nested": lambda s, d: graph.enclosing_symbols(nested_refs(s, d), nested_symbols(s, d)),
    "overlapping_symbols_nested": lambda s, d: graph.overlapping_symbols(nested_symbols(s, d), _lines(s, d).filter(F.col("k") % 50 == 7).select("path", (F.col("k") + 1).cast("long").alias("line"))),
    "reference_edges_languages": lambda s, d: graph.reference_edges(nested_refs(s, d), nested_symbols(s, d)),
    "reference_ranks_languages": lambda s, d: graph.reference_ranks(nested_refs(s, d), nested_symbols(s, d), documents(s, d).select(F.col("rel_path").alias("node"))).select("node", F.round(F.col("rank") * 1_000_000).cast("long").alias("score")),
    "find_references": lambda s, d: graph.find_references(refs(s, d), symbols(s, d), "erthat", max_results=None),
    "goto_definition": lambda s, d: graph.goto_definition(symbols(s, d), "with", max_results=None),
    "incoming_calls": lambda s, d: graph.incoming_calls(refs(s, d), symbols(s, d), symbols(s, d).select("name").distinct()),
    "outgoing_calls": lambda s, d: graph.outgoing_calls(refs(s, d), symbols(s, d), "with"),
    "impact": lambda s, d: graph.impact(refs(s, d), symbols(s, d), "erthat", 2),
    "overlapping_symbols": lambda s, d: graph.overlapping_symbols(symbols(s, d), _lines(s, d).filter(F.col("text").contains("license")).select("path", (F.col("k") + 1).cast("long").alias("line"))),
    "type_expansion": lambda s, d: graph.type_expansion(refs(s, d), symbols(s, d), documents(s, d).filter("size > 9000").select(F.col("rel_path").alias("path")), ["struct"], None),
    "symbol_search": lambda s, d: context.symbol_search(_part_symbols(s, d), "blue bo", max_results=None).select("name", "kind", "signature", "path", "score"),
    "secret_scan": lambda s, d: context.scan_secrets(_log_files(s, d)),
    "cluster_lines": lambda s, d: context.cluster_lines(_hits(s, d, "with"), ["root_id", "rel_path"]),
    "hit_slices": lambda s, d: context.hit_slices(_hits(s, d, "with"), ["root_id", "rel_path"]),
    "merge_ranges": lambda s, d: context.merge_ranges(_hits(s, d, "with").select("root_id", "rel_path", F.greatest(F.col("line") - 1, F.lit(1)).alias("start_line"), (F.col("line") + 1).alias("end_line"), (F.col("occurrences") > 1).cast("string").alias("label")), ["root_id", "rel_path"]),
    "score_fusion": _fused,
    "file_tree": lambda s, d: context.file_tree(page_entries(s, d), max_siblings=20),
    "selection_add": lambda s, d: context.select_ops(_selection(s, d).filter("seq % 2 = 0"), _selection(s, d).filter("seq % 2 = 1"), "add"),
    "last_reason": lambda s, d: context.last_reason(_selection(s, d).select("path", F.col("mode").alias("reason"), "seq"), documents(s, d).filter("size < 500").select(F.col("rel_path").alias("path"))),
}


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of lines for each user, some of them with secrets made up from the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = F.md5(F.col("event_id").cast("string"))
    part = lambda n: F.substring(made, F.lit(1), (F.lit(n) + F.col("event_id") % 5).cast("int"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("use AKIA"), F.upper(part(14)))).when(F.col("event_type") == "click", F.concat(F.lit('db-password: "'), part(14), F.lit('"')))
    line = line.when(F.col("event_type") == "signup", F.concat(F.lit("token github_pat_"), part(18))).when(F.col("event_type") == "error", "-----BEGIN RSA PRIVATE KEY-----")
    line = line.otherwise(F.concat(F.lit("xoxb-"), part(10), F.lit(" key="), F.col("event_id")))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("t")))).alias("l"))
    return rows.select(F.lit("log").alias("root_id"), F.col("user_id").cast("string").alias("rel_path"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lit("src0").alias("root_id"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("mode"), F.col("event_id").alias("seq"))


_HIT = """c AS (SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n$', '') AS text FROM documents WHERE coalesce(text, '') <> ''),
    l AS (SELECT root_id, rel_path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM c),
    h AS (SELECT root_id, rel_path, line, (length(t) - length(replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'with', ''))) // 4 AS n FROM l WHERE contains(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'with'))"""

ORACLE_SQL = {
    "reference_edges": f"WITH {_DEFS} SELECT * FROM e",
    "graph_counters": f"WITH {_DEFS} SELECT (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM dk) AS symbols_indexed",
    "language_files": "SELECT lang AS family, count(*) AS files FROM documents GROUP BY 1",
    "pagerank": _rank_sql(_TRANSITIONS, "node, CAST(round(rank * 100000000) AS BIGINT) AS score"),
    "enclosing_symbols": f"""WITH {_L}, {_ENC} SELECT path, symbol, CAST(line AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", kind, ref_name, CAST(ref_line AS BIGINT) AS ref_line, ref_column, 'call' AS ref_kind FROM en""",
    "find_references": f"""WITH {_L}, n AS (SELECT count(*) AS n FROM s WHERE name = 'erthat') SELECT path, CAST(line AS BIGINT) AS line, "column", 'call' AS kind, name, CASE WHEN n <= 1 OR path IN (SELECT path FROM s WHERE name = 'erthat') THEN 'high' ELSE 'low' END AS confidence FROM r, n WHERE name = 'erthat'""",
    "goto_definition": f"WITH {_L} SELECT path, CAST(line AS BIGINT) AS line, kind, name, (SELECT count(*) FROM s WHERE name = 'with') AS total, false AS truncated FROM s WHERE name = 'with'",
    "incoming_calls": f"""WITH {_L}, {_ENC} SELECT path, symbol, CAST(line AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", kind, ref_name, CAST(ref_line AS BIGINT) AS ref_line, ref_column, 'call' AS ref_kind FROM en WHERE ref_name IN (SELECT name FROM s)""",
    "outgoing_calls": f"""WITH {_L}, {_ENC} SELECT DISTINCT s.name, s.path, CAST(s.line AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", s.kind FROM s WHERE name IN (SELECT ref_name FROM en WHERE symbol = 'with' AND ref_name <> 'with')""",
    "impact": f"""WITH {_L}, {_ENC}, cl AS (SELECT * FROM en WHERE symbol <> ref_name), seed AS (SELECT name, path, line FROM s WHERE name = 'erthat'),
        a AS (SELECT symbol, path, line, min(ref_line * 1000) AS k, min((ref_line, ref_name)) AS m FROM cl WHERE ref_name = 'erthat' AND (symbol, path, line) NOT IN (SELECT (name, path, line) FROM seed) GROUP BY 1, 2, 3),
        b AS (SELECT symbol, path, line, min((ref_line, ref_name)) AS m FROM cl WHERE ref_name IN (SELECT symbol FROM a) AND (symbol, path, line) NOT IN (SELECT (name, path, line) FROM seed) AND (symbol, path, line) NOT IN (SELECT (symbol, path, line) FROM a) GROUP BY 1, 2, 3)
        SELECT symbol, path, CAST(line AS BIGINT) AS line, CAST(1 AS BIGINT) AS depth, m[2] AS via_symbol, CAST(m[1] AS BIGINT) AS reference_line FROM a UNION ALL SELECT symbol, path, CAST(line AS BIGINT), CAST(2 AS BIGINT), m[2], CAST(m[1] AS BIGINT) FROM b""",
    "overlapping_symbols": f"WITH {_L}, ch AS (SELECT path, line FROM l WHERE contains(text, 'license')) SELECT s.path, name, kind, CAST(s.line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, count(*) AS changed_lines FROM s JOIN ch ON ch.path = s.path AND ch.line BETWEEN s.line AND end_line GROUP BY ALL",
    "type_expansion": f"WITH {_L}, sel AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE octet_length(encode(text)) > 9000), u AS (SELECT DISTINCT name FROM r WHERE path IN (SELECT path FROM sel)) SELECT path, min(name) AS name FROM s WHERE kind = 'struct' AND path NOT IN (SELECT path FROM sel) AND name IN (SELECT name FROM u) GROUP BY 1",
    "symbol_search": f"""WITH p AS (SELECT p_name AS name, p_type AS kind, p_brand AS signature, 'part/' || p_partkey AS path, 'part/' || p_partkey AS display_path FROM part), q AS (SELECT *, {_field_sql('blue')} AS a, {_field_sql('bo')} AS b FROM p)
        SELECT name, kind, signature, path, CAST(a + b AS BIGINT) AS score FROM q WHERE a > 0 AND b > 0""",
    "cluster_lines": f"""WITH {_HIT}, g AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY root_id, rel_path ORDER BY line)), i AS (SELECT *, sum(new) OVER (PARTITION BY root_id, rel_path ORDER BY line) AS island FROM g)
        SELECT root_id, rel_path, CAST(island AS BIGINT) AS island, CAST(greatest(min(line) - 2, 1) AS BIGINT) AS start_line, CAST(max(line) + 2 AS BIGINT) AS end_line FROM i WHERE island <= 5 GROUP BY root_id, rel_path, island""",
    "hit_slices": f"WITH {_HIT}, k AS (SELECT *, row_number() OVER (PARTITION BY root_id, rel_path ORDER BY line) AS r FROM h) SELECT root_id, rel_path, CAST(greatest(line - 2, 1) AS BIGINT) AS start_line, CAST(line + 2 AS BIGINT) AS end_line FROM k WHERE r <= 3",
    "merge_ranges": f"""WITH {_HIT}, x AS (SELECT root_id, rel_path, greatest(line - 1, 1) AS a, line + 1 AS b, CASE WHEN n > 1 THEN 'true' ELSE 'false' END AS label FROM h),
        y AS (SELECT *, CASE WHEN label = lag(label) OVER w AND a <= max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY root_id, rel_path ORDER BY a, b)), z AS (SELECT *, sum(new) OVER (PARTITION BY root_id, rel_path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM y)
        SELECT root_id, rel_path, CAST(min(a) AS BIGINT) AS start_line, CAST(max(b) AS BIGINT) AS end_line, min(label) AS label FROM z GROUP BY root_id, rel_path, run""",
    "file_tree": """WITH e AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p, octet_length(encode(html)) AS size FROM pages), v AS (SELECT p, size, unnest(range(1, len(p) + 1)) AS depth FROM e),
        n AS (SELECT coalesce(array_to_string(p[1:depth - 1], '/'), '') AS parent, p[depth] AS name, CASE WHEN depth = len(p) THEN 'file' ELSE 'dir' END AS kind, CAST(depth AS INTEGER) AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY kind, name) AS r FROM n) SELECT parent, name, kind, depth, files, bytes FROM k WHERE r <= 20""",
    "selection_add": "SELECT 'src0' AS root_id, CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS mode, max(event_id) AS seq FROM events GROUP BY user_id",
    "last_reason": "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS reason FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE octet_length(encode(text)) < 500) GROUP BY user_id",
    "score_fusion": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
        l AS (SELECT path, unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) AS t FROM d WHERE text <> ''),
        h AS (SELECT path, count(*) AS n FROM l WHERE contains(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license') GROUP BY 1),
        w AS (SELECT path, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM d),
        f AS (SELECT path, len(list_filter(t, lambda x: x = 'license')) AS tf, greatest(len(t), 1) AS dl, avg(greatest(len(t), 1)) OVER () AS avgdl FROM w),
        b AS (SELECT path, CAST(round((tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1000000) AS BIGINT) AS score FROM f WHERE tf > 0),
        c AS (SELECT d.path, coalesce(h.n, 0) * (coalesce(b.score, 0) + 2000000.0) + length(d.path) * 100 * 0.25 AS search, CAST(size AS DOUBLE) AS repo, (CASE WHEN contains(d.path, '12') THEN 1 ELSE 0 END + CASE WHEN contains(d.path, '7') THEN 1 ELSE 0 END) / 2 AS relevance
              FROM d LEFT JOIN h USING (path) LEFT JOIN b USING (path)),
        m AS (SELECT max(search) AS ms, max(repo) AS mr, max(relevance) AS mv FROM c),
        x AS (SELECT path, 0.55 * CASE WHEN ms > 0 THEN search / ms ELSE 0 END + 0.35 * CASE WHEN mr > 0 THEN repo / mr ELSE 0 END + 0.10 * CASE WHEN mv > 0 THEN relevance / mv ELSE 0 END AS fused FROM c, m)
        SELECT path, CAST(round(fused * 1000000) AS BIGINT) AS fused FROM x WHERE fused > 0""",
    "secret_scan": """WITH t AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'use AKIA' || upper(md5(CAST(event_id AS VARCHAR)))[1:14 + event_id % 5] WHEN 'click' THEN 'db-password: "' || md5(CAST(event_id AS VARCHAR))[1:14 + event_id % 5] || '"'
                       WHEN 'signup' THEN 'token github_pat_' || md5(CAST(event_id AS VARCHAR))[1:18 + event_id % 5] WHEN 'error' THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE 'xoxb-' || md5(CAST(event_id AS VARCHAR))[1:10 + event_id % 5] || ' key=' || event_id END AS line_text,
                       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events),
        k AS (SELECT *, unnest(list_filter([CASE WHEN contains(line_text, '-----BEGIN ') AND contains(line_text, ' PRIVATE KEY-----') THEN 'private_key_block' END, CASE WHEN regexp_matches(line_text, '(AKIA|ASIA)[A-Za-z0-9_.-]{16,}') THEN 'aws_access_key_id' END,
                       CASE WHEN regexp_matches(line_text, '(gh[pousr]_|github_pat_)[A-Za-z0-9_.-]{20,}') THEN 'github_token' END, CASE WHEN regexp_matches(line_text, 'sk-[A-Za-z0-9_.-]{21,}') THEN 'openai_api_key' END, CASE WHEN regexp_matches(line_text, 'xox[bpars]-[A-Za-z0-9_.-]{12,}') THEN 'slack_token' END,
                       CASE WHEN regexp_matches(line_text, 'password: "[a-f0-9]{16,}"') AND regexp_matches(line_text, '"[0-9]*[a-f]') AND regexp_matches(line_text, '"[a-f]*[0-9]') THEN 'generic_secret_assignment' END], lambda x: x IS NOT NULL)) AS kind FROM t)
        SELECT 'log' AS root_id, CAST(user_id AS VARCHAR) AS rel_path, CAST(line AS BIGINT) AS line, kind FROM k""",
}
ORACLE_SQL["enclosing_symbols_nested"] = f"""WITH {_N}, k AS (SELECT nr.path, nr.name AS ref_name, nr.line AS ref_line, nr."column" AS ref_column, ns.name AS symbol, ns.line, ns."column", ns.kind,
        row_number() OVER (PARTITION BY nr.path, nr.line, nr."column" ORDER BY end_line - ns.line, ns.line, ns."column", ns.name, ns.kind) AS r FROM nr JOIN ns ON ns.path = nr.path AND nr.line BETWEEN ns.line AND end_line)
    SELECT path, symbol, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", kind, ref_name, CAST(ref_line AS BIGINT) AS ref_line, ref_column, CASE WHEN length(ref_name) % 2 = 1 THEN 'type' ELSE 'call' END AS ref_kind FROM k WHERE r = 1"""
ORACLE_SQL["overlapping_symbols_nested"] = f"""WITH {_N} SELECT ns.path, name, kind, CAST(ns.line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, count(DISTINCT nl.line) AS changed_lines
    FROM ns JOIN nl ON nl.path = ns.path AND (nl.line - 1) % 50 = 7 AND nl.line BETWEEN ns.line AND end_line GROUP BY ALL"""
ORACLE_SQL["reference_edges_languages"] = f"WITH {_N_EDGES} SELECT * FROM ne"
ORACLE_SQL["reference_ranks_languages"] = _rank_sql(f"{_N_EDGES}, g AS (SELECT * FROM ne), n AS (SELECT CAST(doc_id AS VARCHAR) AS node FROM documents), z AS (SELECT node FROM n)", "node, CAST(round(rank * 1000000) AS BIGINT) AS score")
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
