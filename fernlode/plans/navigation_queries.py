"""Navigation, selection, policy and source queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.functions import text
from fernlode.operators import context, edits, evidence, flow, graph, policy, search
from fernlode.plans.graph_queries import _DEFS, _ENC, _FIELD, _HIT, _L, _field_sql, _hits, _lines, _part_symbols, _rank_sql, refs, symbols
from fernlode.plans.search_queries import _CORPUS, _ENTRIES, _FOLD, _LINES, documents, page_entries
from fernlode.sources import catalog, logs
from fernlode.storage import new_path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unified diff for each document: every line with 'license' is replaced."""
    own = _lines(spark, sf_dir).filter(F.col("text").contains("license"))
    at = (F.col("k") + 1).cast("string")
    hunk = F.concat(F.lit("@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@\n-"), F.col("text"), F.lit("\n+"), F.upper("text"))
    listed = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", hunk.alias("h")))).alias("hs"))
    name = F.concat(F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n"))
    return listed.select(F.col("path").alias("diff_id"), F.concat(name, F.array_join(F.transform("hs", lambda x: x["h"]), "\n")).alias("diff"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("rel_path").alias("path"), "text", text.tokenize_text(F.col("text")).alias("terms"))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python imports from events: a user's file imports the module of the event's type and value."""
    e = _events(spark, sf_dir)
    used = e.select(F.concat(F.lit("app/u"), "user_id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("pkg."), "event_type", F.lit(".m"), F.floor("value").cast("long")).alias("import_path"), F.col("event_id").alias("line"))
    there = e.filter("event_type <> 'error'").select(F.concat(F.lit("pkg/"), "event_type", F.lit("/m"), F.floor("value").cast("long"), F.when(F.col("event_type") == "view", "/__init__.py").otherwise(".py")).alias("path"))
    return graph.resolve_imports(used, there)


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    mode = F.when(F.col("language") == "en", "full").when(F.col("language") == "de", "slices").otherwise("codemap_only")
    return context.selection_summary(d.select("root_id", F.col("rel_path").alias("path"), mode.alias("mode"), F.lit(1).alias("seq")), d)


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source but the last one is a known root."""
    known = documents(spark, sf_dir).select("root_id").distinct()
    last = known.agg(F.max("root_id").alias("last"))
    return known.crossJoin(F.broadcast(last)).filter("root_id <> last").select("root_id", F.concat(F.lit("/srv/"), "root_id", F.lit("-files/")).alias("root_path"))  # one row


def _scout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = documents(spark, sf_dir).select(F.col("rel_path").alias("path"), F.col("size").cast("double").alias("fused"))
    rows = context.scout(ranked, _hits(spark, sf_dir, "with").select(F.col("rel_path").alias("path"), "line"), 12)
    return rows.select("path", "fused", F.explode_outer("ranges").alias("r")).select("path", "fused", F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"))


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part_symbols(spark, sf_dir)
    return context.tool_search(p.select("name", F.col("kind").alias("description"), F.col("signature").alias("params"), F.col("path").alias("param_descriptions")), "brass blue zzz", max_results=None)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"view": "read_file", "click": "edit", "signup": "remember", "error": "plug__x"}.items() for x in kv])
    calls = _events(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.concat(F.lit("run_"), "event_type")).alias("tool"))
    ruled = policy.decide(calls, [("run_*", "deny"), ("*e*", "allow"), ("plug__?", "allow")])
    return ruled.select("event_id", "tool", policy.tool_tier(F.col("tool")).alias("tier"), policy.allowed_without_asking(F.col("tool"), "edit").alias("passes"), "decision")


def _append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends of several files each, the late events first, and the place of each record among those of its user."""
    path, e = new_path(spark, "ndjson"), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    for k in (2, 1, 0):
        logs.append_ndjson(e.filter(F.col("event_id") % 3 == k).repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path)
    rows = logs.read_ndjson(spark, path, "event_id long, user_id long", positions=True)
    return rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("position")).cast("long").alias("place"))


def _catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of folders by source and language; the lines of the files in the folders of src1 to src19 that the catalog lists."""
    path, d = new_path(spark, "tree"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    d.select("source", "lang", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("source", "lang").text(path)
    local = F.regexp_replace("abs_path", "^file:/+", "/")
    own = catalog.scan(spark, {"docs": re.sub("^file:/+", "/", path)}, "source=src1", ".txt", 1)
    bodies = catalog.read_bodies(spark, f"{path}/source=src1*").select(local.alias("abs_path"), F.size(text.lines(catalog.decode("content"))).alias("n"))
    folder = F.regexp_extract("rel_path", "^source=([^/]*)/lang=([^/]*)/", 1), F.regexp_extract("rel_path", "^source=([^/]*)/lang=([^/]*)/", 2)
    return own.join(bodies, "abs_path").groupBy(folder[0].alias("source"), folder[1].alias("lang")).agg(F.sum("n").cast("long").alias("docs"))


def _ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended in two batches and read back; those of a newer schema are passed over."""
    path = new_path(spark, "records")
    e = _events(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_type") == "error", 99).when(F.col("event_type") == "view", 1).alias("schema_version"))
    for part in (e.filter("event_type IN ('view', 'error')"), e.filter("event_type NOT IN ('view', 'error')")):
        logs.append_ndjson(part, path)
    return logs.read_ndjson(spark, path, "event_id long, event_type string, schema_version int", 1).select("event_id", "event_type")


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = edits.plan_replace(documents(spark, sf_dir).filter(F.col("text").contains("license")), "license", "LICENCE", all_matches=True)
    return plan.select("path", "action", "new_path", F.sha2("text", 256).alias("text_hash"))


def _rooted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.join(documents(spark, sf_dir).select(F.col("rel_path").alias("path"), "root_id"), "path")


def _chosen(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return documents(spark, sf_dir).filter(which).select("root_id", F.col("rel_path").alias("path"), F.lit("full" if "size" in which else "codemap_only").alias("mode"), F.lit(int("size" in which)).alias("seq"))


def _plan_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed lines that the diffs of a plan show."""
    corpus = documents(spark, sf_dir).filter(F.col("text").contains("license"))
    diffs = edits.plan_diffs(corpus, edits.plan_replace(corpus, "license", "LICENCE", all_matches=True))
    return logs.changed_lines(diffs.withColumnRenamed("path", "diff_id"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow for each customer, its strategy by the nation; orders start its nodes, and the closed ones are results."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in flow.STRATEGIES]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    flows = c.select(F.col("c_custkey").alias("flow_id"), kind.alias("strategy"), F.lit(2).alias("n"), F.lit(2).alias("rounds"), F.lit(2).alias("k"))
    nodes = flow.compile_flows(flows)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("flow_id"), "o_orderkey", "o_orderstatus")
    names = nodes.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("phase", "node"))).alias("_n"))
    turn = F.row_number().over(Window.partitionBy("flow_id").orderBy("o_orderkey"))
    used = o.withColumn("_k", turn).join(names, "flow_id").select("flow_id", "o_orderstatus", F.try_element_at("_n", F.col("_k"))["node"].alias("node")).filter("node IS NOT NULL")
    return flow.next_actions(nodes, used.select("flow_id", "node"), used.filter("o_orderstatus <> 'P'").select("flow_id", "node", (F.col("o_orderstatus") == "F").alias("ok")))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).select(F.concat(F.lit("r"), "event_id").alias("receipt_id"), F.struct(F.struct(F.col("user_id").cast("string").alias("run_id")).alias("provenance")).alias("statement"))
    return evidence.receipt_for_run(own, "7").select("receipt_id", F.col("statement.provenance.run_id").alias("run_id"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return policy.remember(e.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), "event_type", F.lit(" "), F.repeat(F.lit("x"), (F.col("event_id") % 9).cast("int"))).alias("fact")), cap=200)


def _first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    tables = [e.filter(F.col("event_type") == k).groupBy(F.floor(F.col("event_id") / 4).alias("key")).agg(F.min("event_id").alias("first"), F.lit(k).alias("origin")) for k in ("purchase", "click", "view")]
    return context.first_wins([t.select("key", "first", "origin") for t in tables], "key")


QUERIES = {
    "detect_changes": lambda s, d: graph.detect_changes(_diffs(s, d), symbols(s, d)),
    "changed_lines": lambda s, d: logs.changed_lines(_diffs(s, d)),
    "repo_map": lambda s, d: graph.repo_map((refs(s, d), symbols(s, d)), documents(s, d).select(F.col("rel_path").alias("path")), max_files=None).select("path", F.round(F.col("rank") * 1_000_000).cast("long").alias("score")),
    "seed_files": lambda s, d: graph.seed_files(_files(s, d), ["apache", "license"], literal="copyright"),
    "trace_path": lambda s, d: graph.trace_path(refs(s, d), symbols(s, d), "achein", "einach", 3),
    "referencing_symbols": lambda s, d: graph.referencing_symbols(refs(s, d), symbols(s, d), documents(s, d), "erthat").select("path", "symbol", "line", "kind", "ref_line", "ref_column", "context"),
    "read_symbol": lambda s, d: graph.read_symbol(symbols(s, d), documents(s, d), "with"),
    "read_symbol_body": lambda s, d: graph.read_symbol(symbols(s, d), documents(s, d), "achlich"),
    "confident_references": lambda s, d: graph.find_references(refs(s, d), symbols(s, d), "inthat", confident_only=True),
    "definitions_first": lambda s, d: graph.goto_definition(symbols(s, d), "with", language="rust", max_results=5),
    "resolve_imports": _imports,
    "symbol_search_kind": lambda s, d: context.symbol_search(_part_symbols(s, d), "brand", kind="medium", max_results=None).select("name", "kind", "path", "score"),
    "tool_search": _tools,
    "path_relevance": lambda s, d: page_entries(s, d).select("rel_path", F.round(context.path_relevance(F.col("rel_path"), "blog en Example en") * 1000).cast("long").alias("relevance")),
    "scout": _scout,
    "first_wins": _first_wins,
    "language_from_path": lambda s, d: documents(s, d).select("rel_path", text.language_from_path(F.concat("rel_path", F.lit("."), F.when(F.col("language") == "en", "RS").when(F.col("language") == "de", "tsx").when(F.col("language") == "fr", "hh").otherwise("none"))).alias("found")),
    "display_path": lambda s, d: search.display_path(documents(s, d).select("root_id", "rel_path"), _roots(s, d)),
    "top_content_files": lambda s, d: search.top_content_files(_hits(s, d, "with")),
    "search_report": lambda s, d: search.search_report(documents(s, d), "der", 50),
    "code_scope": lambda s, d: search.code_scope(page_entries(s, d), ["blog.tionsh.example.net/en", "thther.example.org/"]),
    "path_scope_root": lambda s, d: search.path_scope(page_entries(s, d), "site/blog.tionsh.example.net/en", {"web": "/srv/site/"}),
    "auto_codemap": lambda s, d: graph.auto_codemap(_rooted(s, d, refs(s, d)), _rooted(s, d, symbols(s, d)), documents(s, d).filter("size > 9000").select("root_id", F.col("rel_path").alias("path")), ["struct"], 8),
    "selection_preview": lambda s, d: context.selection_preview(_chosen(s, d, "language = 'en'"), documents(s, d), _chosen(s, d, "size < 2000"), "add"),
    "plan_diffs": _plan_diffs,
    "flow_actions": _flows,
    "path_search_top": lambda s, d: search.path_search(page_entries(s, d), "[0-9]+$", regex=True, max_results=10),
    "verdict_query": lambda s, d: evidence.verdict_query(_events(s, d).select(F.concat(F.lit("v"), "event_id").alias("verdict_id"), F.col("user_id").cast("string").alias("run_id")), "7"),
    "ledger_newest": lambda s, d: evidence.ledger_query(_events(s, d).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")), record_kind="click"),
    "receipt_for_run": _receipts,
    "remember": _facts,
    "tool_policy": _calls,
    "args_hash": lambda s, d: _events(s, d).select("event_id", policy.json_hash(F.concat(F.lit('{"z": '), "event_id", F.lit(', "a": ["'), "event_type", F.lit('", null]}'))).alias("args_hash")),
    "selection_summary": _selection,
    "ndjson_round_trip": _ndjson,
    "ndjson_append_order": _append_order,
    "catalog_scan": _catalog_scan,
    "plan_replace": _replaced,
}

_PATHS = "l1 AS (SELECT DISTINCT symbol AS caller, ref_name AS callee FROM en WHERE symbol <> ref_name AND ref_name IN (SELECT name FROM s))"

ORACLE_SQL = {
    "detect_changes": f"WITH {_L}, ch AS (SELECT path, line FROM l WHERE contains(text, 'license')) SELECT s.path, name, kind, CAST(s.line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, count(*) AS changed_lines FROM s JOIN ch ON ch.path = s.path AND ch.line BETWEEN s.line AND end_line GROUP BY ALL",
    "changed_lines": f"WITH {_L} SELECT path AS diff_id, path, CAST(line AS BIGINT) AS line FROM l WHERE contains(text, 'license')",
    "repo_map": _rank_sql(f"{_DEFS}, g AS (SELECT src, dst, weight FROM e), n AS (SELECT CAST(doc_id AS VARCHAR) AS node FROM documents), z AS (SELECT node FROM n)", "node AS path, CAST(round(rank * 1000000) AS BIGINT) AS score"),
    "seed_files": f"WITH {_CORPUS} SELECT rel_path AS node FROM c WHERE contains(lower(rel_path), 'copyright') OR contains(lower(text), 'copyright') OR list_has_any(t, ['apache', 'license'])",
    "trace_path": f"""WITH {_L}, {_ENC}, {_PATHS}, a0 AS (SELECT 'achein' AS name, ['achein'] AS p), a1 AS (SELECT callee AS name, min(list_append(p, callee)) AS p FROM a0 JOIN l1 ON caller = a0.name WHERE callee <> 'achein' GROUP BY 1),
        a2 AS (SELECT callee AS name, min(list_append(p, callee)) AS p FROM a1 JOIN l1 ON caller = a1.name WHERE callee <> 'achein' AND callee NOT IN (SELECT name FROM a1) GROUP BY 1),
        a3 AS (SELECT callee AS name, min(list_append(p, callee)) AS p FROM a2 JOIN l1 ON caller = a2.name WHERE callee <> 'achein' AND callee NOT IN (SELECT name FROM a1 UNION ALL SELECT name FROM a2) GROUP BY 1),
        f AS (SELECT p FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) WHERE name = 'einach') SELECT CAST(unnest(range(len(p))) AS INTEGER) AS step, unnest(p) AS name FROM f""",
    "referencing_symbols": f"""WITH {_L}, {_ENC}, x AS (SELECT path, string_split(text, chr(10)) AS t FROM d)
        SELECT path, symbol, CAST(line AS BIGINT) AS line, kind, CAST(ref_line AS BIGINT) AS ref_line, ref_column, array_to_string(t[greatest(ref_line - 1, 1):least(ref_line + 1, len(t))], chr(10)) AS context FROM en JOIN x USING (path) WHERE ref_name = 'erthat'""",
    "read_symbol": f"""WITH {_L}, k AS (SELECT s.*, substr(l.text, 1, 40) AS signature, count(*) OVER () AS total FROM s JOIN l USING (path, line) WHERE name = 'with') SELECT path, CAST(line AS BIGINT) AS line, kind, signature, CASE WHEN total = 1 THEN '' END AS body, total FROM k ORDER BY path, line, kind, signature LIMIT 20""",
    "read_symbol_body": f"""WITH {_L}, x AS (SELECT path, string_split(text, chr(10)) AS t FROM d), k AS (SELECT s.*, substr(l.text, 1, 40) AS signature, count(*) OVER () AS total FROM s JOIN l USING (path, line) WHERE name = 'achlich')
        SELECT path, CAST(line AS BIGINT) AS line, kind, signature, CASE WHEN total = 1 THEN array_to_string(t[line:end_line], chr(10)) END AS body, total FROM k JOIN x USING (path) ORDER BY path, line, kind, signature LIMIT 20""",
    "confident_references": f"""WITH {_L}, n AS (SELECT count(*) AS n FROM s WHERE name = 'inthat'), c AS (SELECT path, line, "column", CASE WHEN n <= 1 OR path IN (SELECT path FROM s WHERE name = 'inthat') THEN 'high' ELSE 'low' END AS confidence FROM r, n WHERE name = 'inthat')
        SELECT path, CAST(line AS BIGINT) AS line, "column", 'call' AS kind, 'inthat' AS name, confidence FROM c WHERE confidence = 'high' ORDER BY path, line, "column" LIMIT 200""",
    "definitions_first": f"WITH {_L} SELECT path, CAST(line AS BIGINT) AS line, kind, name, (SELECT count(*) FROM s WHERE name = 'with') AS total, (SELECT count(*) FROM s WHERE name = 'with') > 5 AS truncated FROM s WHERE name = 'with' ORDER BY path, line, kind LIMIT 5",
    "resolve_imports": """WITH f AS (SELECT DISTINCT 'pkg/' || event_type || '/m' || CAST(floor(value) AS BIGINT) || CASE WHEN event_type = 'view' THEN '/__init__.py' ELSE '.py' END AS dst FROM events WHERE event_type <> 'error'),
        u AS (SELECT 'app/u' || user_id || '.py' AS src, 'pkg/' || event_type || '/m' || CAST(floor(value) AS BIGINT) AS m FROM events) SELECT src, dst FROM u JOIN f ON dst = m || '.py' OR dst = m || '/__init__.py'""",
    "symbol_search_kind": f"""WITH p AS (SELECT p_name AS name, p_type AS kind, p_brand AS signature, 'part/' || p_partkey AS path, 'part/' || p_partkey AS display_path FROM part), q AS (SELECT *, {_field_sql('brand')} AS a FROM p)
        SELECT name, kind, path, CAST(a AS BIGINT) AS score FROM q WHERE a > 0 AND lower(kind) = 'medium'""",
    "tool_search": f"""WITH p AS (SELECT p_name AS name, p_type AS description, p_brand AS params, 'part/' || p_partkey AS param_descriptions FROM part), q AS (SELECT name, {' + '.join(_field_sql(t, {'name': 40, 'description': 12, 'params': 8, 'param_descriptions': 4}) for t in ('brass', 'blue', 'zzz'))} AS score FROM p)
        SELECT name, CAST(score AS BIGINT) AS score FROM q WHERE score > 0""",
    "path_relevance": f"WITH {_ENTRIES} SELECT rel_path, CAST(round(({' + '.join(f'''CASE WHEN contains({_FOLD.format('rel_path')}, '{t}') THEN 1 ELSE 0 END''' for t in ('blog', 'en', 'example', 'en'))}) / 4 * 1000) AS BIGINT) AS relevance FROM e",
    "scout": f"""WITH {_HIT}, t AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(coalesce(text, ''))) AS DOUBLE) AS fused FROM documents ORDER BY fused DESC, path LIMIT 12),
        g AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY rel_path ORDER BY line)), i AS (SELECT *, sum(new) OVER (PARTITION BY rel_path ORDER BY line) AS island FROM g),
        k AS (SELECT rel_path, CAST(greatest(min(line) - 2, 1) AS BIGINT) AS start_line, CAST(max(line) + 2 AS BIGINT) AS end_line FROM i WHERE island <= 5 GROUP BY rel_path, island) SELECT path, fused, start_line, end_line FROM t LEFT JOIN k ON rel_path = path""",
    "first_wins": """WITH e AS (SELECT event_id // 4 AS key, event_type AS origin, min(event_id) AS first FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1, 2)
        SELECT key, arg_min(first, CASE origin WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS first, arg_min(origin, CASE origin WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS origin FROM e GROUP BY key""",
    "language_from_path": "SELECT CAST(doc_id AS VARCHAR) AS rel_path, CASE lang WHEN 'en' THEN 'rust' WHEN 'de' THEN 'tsx' WHEN 'fr' THEN 'cpp' END AS found FROM documents",
    "display_path": "SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, CASE WHEN source = (SELECT max(source) FROM documents) THEN CAST(doc_id AS VARCHAR) ELSE source || '-files/' || doc_id END AS display_path FROM documents",
    "top_content_files": f"WITH {_HIT} SELECT root_id, rel_path, count(*) AS lines FROM h GROUP BY ALL ORDER BY lines DESC, rel_path, root_id LIMIT 5",
    "search_report": f"""WITH {_CORPUS}, {_LINES}, h AS (SELECT root_id, rel_path, count(*) AS k FROM l WHERE contains({_FOLD.format('line_text')}, 'der') GROUP BY ALL), m AS (SELECT count(*) AS f, sum(k) AS k, sum(least(k, 17)) AS shown FROM h)
        SELECT (SELECT count(*) FROM c) AS scanned_files, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM c) AS scanned_bytes, CAST(0 AS BIGINT) AS binary_skipped, f AS matching_files, CAST(k AS BIGINT) AS matching_lines, CAST(least(shown, 50) AS BIGINT) AS returned, CAST(k - least(shown, 50) AS BIGINT) AS omitted FROM m""",
    "code_scope": f"WITH {_ENTRIES} SELECT * FROM e WHERE rel_path = 'blog.tionsh.example.net/en' OR starts_with(rel_path, 'blog.tionsh.example.net/en/') OR starts_with(rel_path, 'thther.example.org/')",
    "path_scope_root": f"WITH {_ENTRIES} SELECT * FROM e WHERE rel_path = 'blog.tionsh.example.net/en' OR starts_with(rel_path, 'blog.tionsh.example.net/en/')",
    "auto_codemap": f"""WITH {_L}, t AS (SELECT CAST(doc_id AS VARCHAR) AS path, source AS root_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents), u AS (SELECT DISTINCT root_id, name FROM r JOIN t USING (path) WHERE size > 9000)
        SELECT root_id, path, min(name) AS name FROM s JOIN t USING (path) WHERE kind = 'struct' AND size <= 9000 AND (root_id, name) IN (SELECT (root_id, name) FROM u) GROUP BY root_id, path ORDER BY name, root_id, path LIMIT 8""",
    "selection_preview": """WITH d AS (SELECT octet_length(encode(coalesce(text, ''))) AS size, lang FROM documents) SELECT CASE WHEN size < 2000 THEN 'full' ELSE 'codemap_only' END AS mode, count(*) AS files, CAST(sum(CASE WHEN size < 2000 THEN ceil(size / 4) ELSE 0 END) AS BIGINT) AS tokens
        FROM d WHERE lang = 'en' OR size < 2000 GROUP BY 1""",
    "plan_diffs": f"WITH {_L} SELECT path AS diff_id, path, CAST(line AS BIGINT) AS line FROM l WHERE contains(text, 'license')",
    "flow_actions": """WITH f AS (SELECT c_custkey AS flow_id, c_nationkey % 7 AS s FROM customer),
        t AS (SELECT * FROM (VALUES (0, 0, 'step0', 1), (1, 0, 'branch0', 1), (1, 0, 'branch1', 1), (2, 0, 'step0', 1), (2, 1, 'step1', 1), (3, 0, 'map0', 0), (3, 0, 'map1', 0), (3, 1, 'reduce0', 1), (4, 0, 'candidate0', 2), (4, 0, 'candidate1', 2), (4, 1, 'judge0', 1),
              (5, 0, 'turn0-0', 0), (5, 0, 'turn0-1', 0), (5, 1, 'turn1-0', 0), (5, 1, 'turn1-1', 0), (5, 2, 'judge0', 1), (6, 0, 'plan0', 1), (6, 1, 'worker0', 0), (6, 1, 'worker1', 0), (6, 2, 'summary0', 1)) AS t(s, phase, node, least)),
        n AS (SELECT flow_id, phase, node, least, row_number() OVER (PARTITION BY flow_id ORDER BY phase, node) AS k FROM f JOIN t USING (s)),
        o AS (SELECT o_custkey AS flow_id, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
        r AS (SELECT n.*, st IS NOT NULL AS begun, CASE WHEN st <> 'P' THEN st = 'F' END AS ok FROM n LEFT JOIN o USING (flow_id, k)),
        p AS (SELECT flow_id, phase, least, count(ok) = count(*) AS settled, count(*) FILTER (WHERE ok) < least AS low FROM r GROUP BY flow_id, phase, least),
        g AS (SELECT flow_id, min(phase) FILTER (WHERE NOT settled OR low) AS front FROM p GROUP BY 1), w AS (SELECT g.flow_id, front, coalesce(settled AND low, false) AS short FROM g LEFT JOIN p ON p.flow_id = g.flow_id AND p.phase = g.front)
        SELECT r.flow_id, 'start' AS action, node, CAST(NULL AS BOOLEAN) AS ok FROM r JOIN w ON w.flow_id = r.flow_id AND front = phase WHERE NOT short AND NOT begun
        UNION ALL SELECT flow_id, 'finish', NULL, front IS NULL FROM w WHERE front IS NULL OR short""",
    "path_search_top": f"""WITH {_ENTRIES} SELECT root_id, rel_path, CAST(900000 - octet_length(encode(rel_path)) - 2 * (length(rel_path) - length(regexp_extract(rel_path, '[0-9]+$'))) AS BIGINT) AS score
        FROM e WHERE regexp_matches(rel_path, '[0-9]+$') ORDER BY score DESC, rel_path, root_id LIMIT 10""",
    "verdict_query": "SELECT 'v' || event_id AS verdict_id, CAST(user_id AS VARCHAR) AS run_id FROM events WHERE user_id = 7",
    "ledger_newest": "SELECT event_id AS seq, event_type AS kind FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 200",
    "receipt_for_run": "SELECT min('r' || event_id) AS receipt_id, '7' AS run_id FROM events WHERE user_id = 7",
    "remember": """WITH RECURSIVE f AS (SELECT user_id AS project, trim(event_type || ' ' || repeat('x', CAST(event_id % 9 AS INTEGER))) AS fact, min(event_id) AS seq FROM events GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM f),
        r AS (SELECT project, CAST(0 AS BIGINT) AS k, 58 AS size, CAST(-1 AS INTEGER) AS place, '' AS fact, false AS kept FROM (SELECT DISTINCT project FROM f)
              UNION ALL SELECT r.project, o.k, CASE WHEN r.size + length(o.fact) + 3 <= 200 THEN r.size + length(o.fact) + 3 ELSE r.size END, CASE WHEN r.size + length(o.fact) + 3 <= 200 THEN r.place + 1 ELSE r.place END, o.fact, r.size + length(o.fact) + 3 <= 200 FROM r JOIN o ON o.project = r.project AND o.k = r.k + 1)
        SELECT project, place, fact FROM r WHERE kept""",
    "tool_policy": """WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'remember' WHEN 'error' THEN 'plug__x' ELSE 'run_' || event_type END AS tool FROM events),
        u AS (SELECT *, CASE WHEN tool IN ('read_file', 'remember') THEN 'read_only' WHEN tool = 'edit' THEN 'edit' ELSE 'exec' END AS tier FROM t)
        SELECT event_id, tool, tier, tier <> 'exec' AS passes, CASE WHEN starts_with(tool, 'run_') THEN 'deny' WHEN contains(tool, 'e') THEN 'allow' ELSE 'ask' END AS decision FROM u""",
    "args_hash": """SELECT event_id, sha256('{"a":["' || event_type || '",null],"z":' || event_id || '}') AS args_hash FROM events""",
    "selection_summary": """SELECT CASE lang WHEN 'en' THEN 'full' WHEN 'de' THEN 'slices' ELSE 'codemap_only' END AS mode, count(*) AS files, CAST(sum(CASE WHEN lang = 'en' THEN ceil(octet_length(encode(coalesce(text, ''))) / 4) ELSE 0 END) AS BIGINT) AS tokens FROM documents GROUP BY 1""",
    "ndjson_append_order": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id) AS place FROM events",
    "catalog_scan": "SELECT source, coalesce(nullif(lang, ''), '__HIVE_DEFAULT_PARTITION__') AS lang, count(*) AS docs FROM documents WHERE source LIKE 'src1%' GROUP BY 1, 2",
    "ndjson_round_trip": "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
    "plan_replace": "SELECT CAST(doc_id AS VARCHAR) AS path, 'update' AS action, CAST(NULL AS VARCHAR) AS new_path, sha256(replace(text, 'license', 'LICENCE')) AS text_hash FROM documents WHERE contains(text, 'license')",
}
