"""How the sources of a language differ: the terms that a source overuses, and the distance between sources.

Terms are runs of letters and other non-ASCII characters, A-Z lower-cased; a language keeps the terms in at least
``MIN_DOCUMENTS`` of its documents.  With V kept terms and N their occurrences in a group, a term with c
occurrences has p = 1 + floor(10^9 (c + 5) / (N + 5 V)); f = |p - q| for two groups, all in integers.

Terms of a group (upper-bound search): all terms that a group holds equally often have the same p, so they form a bucket
whose best f is p less the bucket's smallest probability in the language.  Buckets are evaluated best
first, for all groups at once in rounds that grow: a round takes the unseen buckets in the order of their bounds, but none whose
bound is strictly below the group's 50th value so far, and the search ends when no such bucket is left.

Pairs of sources (postings): f sums to V |b - b'| over terms that neither holds (b the value of no occurrence), and what
a held term changes depends on the pair of counts alone.  A term of one source changes the sum by a figure of
its bucket; a term of both by one more, which the postings of the term give.  So the vocabulary is never multiplied by the pairs.

Cases: null text, lang and source count as ''; a group without terms is reported, with the pairs of its language;
without kept terms (V = 0) a pair's value is 0; an empty table gives an empty result; repeated rows and ids count as documents
of their own; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, map_batches, materialize

MIN_DOCUMENTS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
GROWTH = 8
FLUSH_TERMS = 200_000
BROADCAST_ROWS = 200_000
GROUP = ["lang", "source"]
#: Separators become spaces, A-Z small letters; bytes of other characters stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), and a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def parts() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, found) in counts.items():
                k = len(times)
                columns = [pa.array([lang] * (k + 1)), pa.array([source] * (k + 1)), pa.array([*(t.decode() for t in times), None], pa.string()), pa.array([*times.values(), 0], pa.int64()), pa.array([*(found[t] for t in times), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*GROUP, "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                times, found = counts.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.translate(FOLDED).split())
                held -= len(times)
                times.update(own)
                held += len(times)
                found.update(own.keys())
                if held > FLUSH_TERMS:
                    yield from parts()
                    counts.clear()
                    held = 0
        yield from parts()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(name("lang"), name("source"), name("text")).withColumn("text", F.col("text").cast("binary"))
    counted = map_batches(texts, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exactly."""
    part = ((F.col(count) if isinstance(count, str) else count) + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    whole = (F.col(total) + PRIOR * F.col(terms)).cast("decimal(20,0)")
    # An integer below 10^30 over one below 10^20: the quotient is cut, not rounded, by the integral division.
    return F.call_function("div", part, whole) + 1


def postings(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, p, q) of the kept terms, and the groups (lang, source, total, terms, base)."""
    words = counts.filter("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_documents).drop("docs")
    kept = materialize(kept, "kept_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = materialize(words.select(*GROUP, "term", "n").join(broadcast_if_small(kept, BROADCAST_ROWS), ["lang", "term"]), "held_terms")
    totals = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select(*GROUP).join(totals, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = materialize(groups.withColumn("base", F.when(F.col("terms") > 0, _p(F.lit(0), "total", "terms")).otherwise(F.lit(0))), "groups", narrow=True)
    small = broadcast_if_small(groups, BROADCAST_ROWS)
    rows = held.join(small, GROUP).select(*GROUP, "term", "n", _p("n", "total", "terms").alias("p"), _p("lang_n", "lang_total", "terms").alias("q"))
    return materialize(rows, "postings"), groups


def overused_terms(rows: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: each group's terms with p > q, largest p - q first, ties in the order of the terms' bytes."""
    buckets = rows.groupBy(*GROUP, "n", "p").agg(F.min("q").alias("q"), F.count("*").alias("size"))
    buckets = buckets.withColumn("bound", F.col("p") - F.col("q")).drop("q").filter("bound > 0")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    # The terms in the group's better buckets: a group has fewer buckets than the square root of twice its occurrences.
    buckets = materialize(buckets.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))), "buckets")
    best, quota, start = None, top, 0
    while True:
        unseen = buckets.filter(F.col("before") >= start) if start else buckets
        if best is not None:
            kth = best.groupBy(*GROUP).agg(F.when(F.count("*") >= top, F.min("value")).alias("kth"))
            unseen = unseen.join(broadcast_if_small(materialize(kth, "kth", narrow=True), BROADCAST_ROWS), GROUP, "left").filter("kth IS NULL OR bound >= kth").drop("kth")
        chosen = materialize(unseen.filter(F.col("before") < quota).select(*GROUP, "n"), "chosen", narrow=True)
        if best is None or not chosen.isEmpty():
            found = rows.join(broadcast_if_small(chosen, BROADCAST_ROWS), [*GROUP, "n"]).filter("p > q")
            found = _ranked(found.select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), top)
            best = materialize(found if best is None else _ranked(best.drop("rank").unionByName(found.drop("rank")), top), "best")
        elif unseen.isEmpty():
            return best
        start, quota = quota, quota * GROWTH


def _ranked(found: DataFrame, top: int | None) -> DataFrame:
    """rank by value downwards, then item; Spark keeps only the first ``top`` of a partition before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    out = found.withColumn("rank", rank)
    return out if top is None else out.filter(F.col("rank") <= top)


def source_distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the sum of f over the language's terms for each pair of its sources, largest first."""
    own = rows.join(broadcast_if_small(groups.select(*GROUP, "base"), BROADCAST_ROWS), GROUP)
    other = lambda frame, *names: frame.select("lang", *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = groups.select(*GROUP, "base", "terms").join(other(groups, "source", "base"), "lang").filter("source <> source_b")
    apart = F.abs(F.col("base") - F.col("base_b"))
    # What a term held by the first source alone changes, bucket by bucket.
    buckets = materialize(rows.groupBy(*GROUP, "p").agg(F.count("*").alias("size")), "sizes")
    alone = buckets.join(broadcast_if_small(groups.select(*GROUP, "base"), BROADCAST_ROWS), GROUP).join(broadcast_if_small(other(groups, "source", "base"), BROADCAST_ROWS), "lang").filter("source <> source_b")
    alone = alone.groupBy(*GROUP, "source_b").agg(F.sum((F.abs(F.col("p") - F.col("base_b")) - apart) * F.col("size")).alias("part"))
    swapped = alone.select("lang", F.col("source_b").alias("source"), F.col("source").alias("source_b"), "part")
    # What a term held by both changes on top of that, from the postings of the term.
    met = own.select(*GROUP, "term", "p", "base").join(own.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "base")]), ["lang", "term"]).filter("source < source_b")
    both = F.abs(F.col("p") - F.col("p_b")) - F.abs(F.col("p") - F.col("base_b")) - F.abs(F.col("p_b") - F.col("base")) + apart
    met = met.groupBy(*GROUP, "source_b").agg(F.sum(both).alias("part"))
    mirrored = met.select("lang", F.col("source_b").alias("source"), F.col("source").alias("source_b"), "part")
    none = pairs.select(*GROUP, "source_b", (F.col("terms") * apart).alias("part"))
    value = none.unionByName(alone).unionByName(swapped).unionByName(met).unionByName(mirrored).groupBy(*GROUP, "source_b").agg(F.sum("part").cast("long").alias("value"))
    return _ranked(value.withColumnRenamed("source_b", "item"), None)


def source_audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank over all documents."""
    counts = materialize(term_counts(docs), "term_counts")
    rows, groups = postings(counts, min_documents)
    parts = [("pair", source_distances(rows, groups)), ("term", overused_terms(rows, top))]
    first, second = (frame.select(*GROUP, F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for name, frame in parts)
    return first.unionByName(second)
