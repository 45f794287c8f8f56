"""Queries of the pipeline operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    """The vocabulary file is a parameter of the operators; the queries take the public one of this environment."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.quality import score_quality, train_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), word_bpe_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.wrappers import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.suffix import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.toxicity import score_toxicity, train_toxicity

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, similarity=80)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.embeddings import embedding_duplicates

    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.warc import round_trip

    records = round_trip(_table(spark, sf_dir, "pages"), with_payload=False)
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.divergence import source_audit

    return source_audit(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlode.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_html": op4_html,
    "op5_suffix": op5_suffix,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_embeddings": op8_embeddings,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_exact": op11_exact,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op5_suffix": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             o AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 1000)) AS o FROM d),
             c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2198) AS part, least(1000, length(h) // 2 - 99 - o) AS m FROM o),
             p AS (SELECT doc_id, o, part, unnest(range(0, m)) AS t FROM c),
             w AS (SELECT doc_id, o + t AS s, row_number() OVER (PARTITION BY substr(part, 2 * t + 1, 200) ORDER BY doc_id, o + t) AS k FROM p),
             i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM w WHERE k > 1),
             j AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
             r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM j GROUP BY doc_id, run),
             q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
             t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)""",
    "op7_minhash": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) ELSE ws END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x AND r.c < e.y),
             m AS (SELECT x, min(c) AS c FROM r GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id""",
    "op8_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.x AND r.c < p.y),
        n AS (SELECT x, count(*) AS k FROM p GROUP BY x),
        m AS (SELECT x, min(c) AS c FROM r GROUP BY x)
        SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
        FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN m ON m.x = e.vec_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM m""",
    "op11_exact": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
             g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_divergence": """
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
             l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL),
             gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
             full_grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
                             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(gn.n, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (kept.c + 5)) // (l.n + 5 * l.v) AS q
                      FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
             pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM full_grid a JOIN full_grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                           LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
                       UNION ALL SELECT lang, source, 'term', term, p - q FROM full_grid WHERE c > 0 AND p > q),
             r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_spelling": """
        WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
             crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
             d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
             u AS (SELECT doc_id, run, count(*) AS n, CAST(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS VARCHAR) AS s FROM d WHERE length(run) >= 6 GROUP BY doc_id, run),
             y AS (SELECT doc_id, run, n, list_transform(range(0, strlen(s)), lambda k: CAST(('0x' || substr(hex(encode(s)), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT)) AS bytes FROM u),
             h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) + 1 AS BIGINT)])), 4294967295) AS h FROM y, crc),
             v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
             w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
             x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w),
             z AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS cut FROM x),
             e AS (SELECT a.word AS a, b.word AS b FROM z a JOIN z b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word UNION SELECT z.word, w.word FROM z JOIN w ON z.cut = w.word UNION SELECT w.word, z.word FROM z JOIN w ON z.cut = w.word),
             o AS (SELECT e.a AS word, e.b AS other, w.n AS m, count(*) OVER (PARTITION BY e.a) AS n_near, row_number() OVER (PARTITION BY e.a ORDER BY w.n DESC, encode(e.b)) AS r FROM e JOIN w ON w.word = e.b),
             f AS (SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.m >= 5 * w.n THEN o.other END AS form, CASE WHEN o.m >= 5 * w.n THEN o.m END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND o.r = 1),
             p AS (SELECT word, word AS at FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.at WHERE f.form IS NOT NULL),
             root AS (SELECT p.word, p.at AS root FROM p JOIN f ON f.word = p.at WHERE f.form IS NULL)
        SELECT f.word, f.form, root.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)""",
}
