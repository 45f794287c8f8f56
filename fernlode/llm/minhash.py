"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Shingles are k words; a text with fewer words is one shingle, one without words has none and
links with nothing.  SuperMinHash gives each element its own permutation of the slots: step j
offers slot p(j) the value j + r, so values of step j can never beat one of an earlier step, and a
document stops as soon as every slot holds a value of the current step or an earlier one.
Here all documents of a batch take the same step at once.

Documents with equal shingle sets are one class.  Classes that share a band are compared with the
smallest of the band.  Pairs of a band that are in different components after that are compared
with each other unless the counts from the first comparison rule them out (see ``_across``); those that are in the
component of the band's smallest class meet only the others, and never each other.  So no link
that the bands find is lost, while a band of many copies costs one comparison a copy and not one a
pair.  Every link is confirmed on full sets.  With ``bands`` x ``rows`` = 48 x 6 a pair at the threshold of 0.8 shares no band with
probability 5e-7.

Rows that share a doc_id but not the text stand for themselves while links are sought, each text under a number of
its own.  The report then takes them as one document, linked with what any of its texts is near to; ``drop_near_duplicates``
goes by the texts, so that none is lost that nothing else is near to.

Cases: null and empty texts have size 0, their own component, and are kept; a row with a null doc_id is in
no component and kept; of rows with equal sets and ids all stay or go; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlode.llm.bytehash import mix, text_chunks, word_hashes
from fernlode.llm.columns import column, own_columns
from fernlode.llm.components import connected_components
from fernlode.storage import broadcast_if_small, map_batches, materialize

_U = np.uint64
SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS = 48, 6
DENSE_FROM = 6
EMPTY = _U(2**64 - 1)
BROADCAST_IDS = 400_000
CHUNK_BYTES = 192 << 10


def shingle_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a chunk of texts at a time."""
    factors = mix(np.arange(1, k + 2, dtype=_U)) | _U(1)
    for _, data, offsets in text_chunks(column, CHUNK_BYTES):
        words, first = word_hashes(data, offsets)
        grams = np.zeros(max(len(words) - k + 1, 0), _U)
        for t in range(k):
            grams += words[t : t + len(grams)] * factors[t]
        grams = mix(grams)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                short = np.append(words[a:b] * factors[: b - a], factors[k : k + 1] * _U(b - a)).sum(dtype=_U)
                out.append(mix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
        yield out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m): the step in the upper 32 bits, the draw in the lower."""
    n = len(sets)
    h = np.full((n, m), EMPTY, _U)
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), sizes)
    element = np.concatenate(sets) if n else np.zeros(0, _U)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    dense: np.ndarray | None = None
    flat = h.reshape(-1)
    for j in range(m):
        if len(element) == 0:
            break
        draw = mix(element + _U((j + 1) * 0xD1342543DE82EF95 % 2**64))
        value = (_U(j) << _U(32)) | (draw >> _U(32))
        k = j + (((draw & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        if j == DENSE_FROM:  # few and small documents come this far: whole permutations for their elements
            dense = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
            for i, (at, old) in enumerate(moved):
                dense[np.arange(len(element)), at] = old
        if dense is None:
            slot, old = k.copy(), np.full(len(k), j)
            for at, was in moved:  # the latest swap that touched a place holds
                slot = np.where(at == k, was, slot)
                old = np.where(at == j, was, old)
            moved.append((k, old))
        else:
            rows = np.arange(len(element))
            slot = dense[rows, k].astype(np.int64)
            dense[rows, k] = dense[:, j]
        np.minimum.at(flat, doc * m + slot, value)
        going = np.zeros(n, bool)
        active = np.unique(doc)
        going[active] = h[active].max(axis=1) >= (_U(j + 1) << _U(32))
        keep = going[doc]
        if not keep.all():
            element, doc = element[keep], doc[keep]
            moved = [(a[keep], b[keep]) for a, b in moved]
            dense = None if dense is None else dense[keep]
    return h


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), _U)
    parts = signatures.reshape(len(signatures), bands, rows)
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return mix(out + np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """set_a and set_b (a 128-bit hash of each set) and its size."""
    return [*(pa.array([int(mix(s + _U(salt)).sum(dtype=_U).view(np.int64)) for s in sets], pa.int64()) for salt in (1, 2)), pa.array([len(s) for s in sets], pa.int64())]


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit hash of the set) and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), k):
                ids = batch.column(0).slice(at, len(sets))
                at += len(sets)
                own = band_hashes(superminhash(sets, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, bands), pa.int32()), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, *_set_hashes(sets), lists], names=["doc_id", *OF_SET, "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, set_a long, set_b long, n_shingles long, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, aliases: DataFrame | None, k: int) -> DataFrame:
    """(id, full shingle set) of the documents in ``ids``."""

    def sets(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for own in shingle_sets(batch.column(1), k):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(own)), *_set_hashes(own), pa.array([s.tobytes() for s in own], pa.binary())], names=[name, *OF_SET, "grams"])
                    at += len(own)

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    fields = "set_a long, set_b long, n_shingles long, grams binary"
    plain = map_batches(texts.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi"), sets("id"), f"id long, {fields}").filter("n_shingles > 0").select("id", "grams")
    if aliases is None:
        return plain
    several = texts.withColumnRenamed("id", "doc_id").join(broadcast_if_small(aliases.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")
    named = map_batches(several, sets("doc_id"), f"doc_id long, {fields}").join(aliases, ["doc_id", *OF_SET]).select(F.col("alias").alias("id"), "grams")
    return plain.unionByName(named.join(ids, "id", "left_semi"))


def _measured(pairs: DataFrame, sets: DataFrame, own_part: bool = False) -> DataFrame:
    """(src, dst, src_n, dst_n, common) on full sets; with ``own_part`` also what src has and dst has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), _U) for x in (a, b))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = b[at] == a
                rows.append((len(a), len(b), int(shared.sum())))
                own.append(a[~shared].view(np.int64) if own_part else [])
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts, pa.array(own, pa.list_(pa.int64()))], names=["src", "dst", "src_n", "dst_n", "common", "own"])

    own = sets.select(F.col("id").alias("src"), F.col("grams").alias("a"))
    other = sets.select(F.col("id").alias("dst"), F.col("grams").alias("b"))
    joined = pairs.select("src", "dst").join(own, "src").select("src", "dst", "a").join(other, "dst").select("src", "dst", "a", "b")
    return map_batches(joined, run, "src long, dst long, src_n long, dst_n long, common long, own array<long>")


def _links(measured: DataFrame, similarity: int) -> DataFrame:
    return measured.filter(100 * F.col("common") >= similarity * (F.col("src_n") + F.col("dst_n") - F.col("common"))).select("src", "dst")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("_n")).drop("_n")


def _close(a: str, b: str, similarity: int):
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


OF_SET = ["set_a", "set_b", "n_shingles"]


def _aliases(usable: DataFrame) -> DataFrame | None:
    """doc_id, the set, alias: a number below every doc_id for each text of a doc_id that has several; None where there is no such id."""
    ids = usable.groupBy("doc_id").agg(F.min(F.struct(*OF_SET)).alias("lo"), F.max(F.struct(*OF_SET)).alias("hi")).filter("lo <> hi").select("doc_id")
    ids = materialize(ids, "repeated_ids", narrow=True)
    if ids.isEmpty():
        return None
    least = min(usable.agg(F.min("doc_id")).first()[0], 0)
    texts = usable.join(broadcast_if_small(ids, BROADCAST_IDS), "doc_id", "left_semi").groupBy("doc_id", *OF_SET).agg(F.count("*").alias("_n")).drop("_n")
    return materialize(texts.withColumn("alias", F.lit(least - 1) - F.monotonically_increasing_id()), "aliases", narrow=True)


def _with_id(rows: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """rows with id: the doc_id, or the alias of the row's text."""
    if aliases is None:
        return rows.withColumn("id", F.col("doc_id"))
    return rows.join(broadcast_if_small(aliases, BROADCAST_IDS), ["doc_id", *OF_SET], "left").withColumn("id", F.coalesce("alias", "doc_id")).drop("alias")


def _grouped(docs: DataFrame, k: int, similarity: int, bands: int, rows: int, by_text: bool) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, the set, id, component) of every row, and the aliases; ``by_text``: texts that share a doc_id are not linked by it."""
    signed = materialize(signatures(docs, k, bands, rows), "signatures")
    aliases = _aliases(signed.filter("doc_id IS NOT NULL"))
    signed = _with_id(signed, aliases)
    usable = signed.filter("id IS NOT NULL AND n_shingles > 0")
    # A class of equal sets is represented by its smallest id; the classes of several rows are few and a table of their own.
    classes = materialize(usable.groupBy(*OF_SET).agg(F.min("id").alias("rep"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "classes")
    classes = broadcast_if_small(classes, BROADCAST_IDS)
    known = usable.join(classes, OF_SET, "left")
    reps = known.filter("rep IS NULL OR rep = id").select("id", "n_shingles", "bands")
    banded = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    members = _shared(banded)
    sets = materialize(_sets_of(docs, materialize(members.groupBy("id").agg(F.count("*").alias("_n")).select("id"), "member_ids", narrow=True), aliases, k), "sets")
    stars = _distinct(members.filter(F.col("id") != F.col("pivot")).select(F.col("id").alias("src"), F.col("pivot").alias("dst")))
    measured = materialize(_measured(stars, sets).drop("own"), "stars")
    links = _links(measured, similarity)
    if aliases is not None and not by_text:
        own = signed.filter("id <> doc_id").join(classes, OF_SET, "left").groupBy("doc_id", F.coalesce("rep", "id").alias("src")).agg(F.count("*").alias("_n"))
        links = links.unionByName(materialize(own.join(own.groupBy("doc_id").agg(F.min("src").alias("dst")), "doc_id").filter("src <> dst").select("src", "dst"), "same_ids", narrow=True))
    components = connected_components(links)
    across = materialize(_across(members, measured, components, sets, similarity), "across", narrow=True)
    more = materialize(_links(_measured(across, sets), similarity), "links", narrow=True)
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    components = broadcast_if_small(components, BROADCAST_IDS)
    out = signed.drop("bands").join(classes, OF_SET, "left").withColumn("node", F.coalesce("rep", "id")).join(components, "node", "left")
    return out.select("doc_id", *OF_SET, "id", F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component")), aliases


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links at ``similarity`` per cent or more."""
    out, aliases = _grouped(docs, k, similarity, bands, rows, by_text=False)
    component = F.col("component")
    if aliases is not None:  # a component with an alias takes its smallest doc_id
        out = materialize(out, "grouped")
        by_id = out.join(broadcast_if_small(aliases.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("_c"))
        out = out.join(broadcast_if_small(materialize(by_id, "of_ids", narrow=True), BROADCAST_IDS), "doc_id", "left").withColumn("component", F.coalesce("_c", "component"))
        least = out.groupBy("component").agg(F.min("doc_id").alias("_least"), F.min("id").alias("_id")).filter("_least <> component").select("component", "_least")
        out = out.join(broadcast_if_small(materialize(least, "least", narrow=True), BROADCAST_IDS), "component", "left")
        component = F.coalesce("_least", "component")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _shared(banded: DataFrame) -> DataFrame:
    """The rows of bands that several classes have, with the band's smallest class, as a written table."""
    shared = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("in_band")).filter("in_band > 1")
    shared = materialize(shared.select("band", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), "in_band"), "shared_bands")
    return materialize(banded.join(broadcast_if_small(shared, BROADCAST_IDS), "band"), "members")


def _across(members: DataFrame, measured: DataFrame, components: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs of a band in different components that can still reach the similarity; no such pair is left out.

    Let M be the band's smallest class together with the elements that most of its band have beside it. S and
    X share at most min(|S and M|, |X and M|) elements inside M, and these counts are known. So a pair qualifies
    by that bound alone, or it must share elements outside M, and then one of its first ones in order of
    rarity (prefix filtering: with m the least size that X can have, S has n - t (n + m) / (100 + t) + 1 of them to look at).
    """
    own = broadcast_if_small(components.select(F.col("node").alias("id"), "component"), BROADCAST_IDS)
    rows = members.select("band", "id", "n", "pivot").join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))
    pivots = own.select(F.col("id").alias("pivot"), F.col("component").alias("_of_pivot"))
    rows = rows.join(pivots, "pivot", "left").withColumn("rest", F.col("component") != F.coalesce("_of_pivot", "pivot")).drop("_of_pivot")
    mixed = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    rows = rows.filter(F.col("id") != F.col("pivot")).join(broadcast_if_small(materialize(mixed, "mixed", narrow=True), BROADCAST_IDS), "band")
    inside = measured.select(F.col("src").alias("id"), F.col("dst").alias("pivot"), F.col("common").alias("i"))
    rows = materialize(rows.join(inside, ["id", "pivot"]), "mixed_members")

    def side(frame: DataFrame, by: str, mark: str) -> DataFrame:
        return frame.select(by, *(["pivot"] if by != "band" else []), *(F.col(c).alias(f"{c}_{mark}") for c in ("id", "n", "i", "component", "rest")))

    def met(frame: DataFrame, on: list[str], extra) -> DataFrame:
        pairs = side(frame.filter("rest"), on[0], "a").join(side(frame, on[0], "b"), on)
        once = ~F.col("rest_b") | (F.col("id_a") > F.col("id_b"))
        pairs = pairs.filter(once & (F.col("component_a") != F.col("component_b")) & _close("n_a", "n_b", similarity) & extra)
        return pairs.select(F.greatest("id_a", "id_b").alias("src"), F.least("id_a", "id_b").alias("dst"))

    alone = rows.groupBy("id", "pivot", "n", "i", "component", "rest").agg(F.count("*").alias("_n")).drop("_n")
    outside = _measured(alone.select(F.col("id").alias("src"), F.col("pivot").alias("dst")), sets, own_part=True)
    outside = materialize(outside.select(F.col("src").alias("id"), F.col("dst").alias("pivot"), F.explode("own").alias("element")), "outside")
    groups = broadcast_if_small(materialize(alone.groupBy("pivot").agg(F.count("*").alias("members"), F.min("n").alias("least")), "groups", narrow=True), BROADCAST_IDS)
    rarity = materialize(outside.groupBy("pivot", "element").agg(F.count("*").alias("df")).filter("df > 1").join(groups, "pivot"), "rarity")
    ranked = outside.join(rarity, ["pivot", "element"], "left").withColumn("usual", F.coalesce(2 * F.col("df") > F.col("members"), F.lit(False)))
    ranked = materialize(ranked.select("id", "pivot", "element", F.coalesce("df", F.lit(1)).alias("df"), "usual"), "ranked")
    usual = ranked.filter("usual").groupBy("id", "pivot").agg(F.count("*").alias("extra"))
    counted = F.col("i") + F.coalesce("extra", F.lit(0))
    alone = materialize(alone.join(usual, ["id", "pivot"], "left").withColumn("i", counted).drop("extra").join(groups, "pivot"), "alone")
    rows = rows.drop("i").join(alone.select("id", "pivot", "i"), ["id", "pivot"])
    most = F.least("i_a", "i_b")
    bounded = met(rows, ["band"], 100 * most >= similarity * (F.col("n_a") + F.col("n_b") - most))
    order = Window.partitionBy("id", "pivot").orderBy("df", "element")
    placed = ranked.filter(~F.col("usual")).withColumn("place", F.row_number().over(order)).filter("df > 1")
    smallest = F.greatest(F.col("least"), F.col("n") * similarity / 100)
    prefix = placed.join(alone, ["id", "pivot"]).filter(F.col("place") <= F.col("n") - similarity * (F.col("n") + smallest) / (100 + similarity) + 1.001)
    sharing = met(prefix.select("element", "pivot", "id", "n", "i", "component", "rest"), ["element", "pivot"], F.lit(True))
    tested = measured.select("src", "dst")
    return _distinct(bounded.unionByName(sharing)).join(tested, ["src", "dst"], "left_anti")


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The documents that stay, all columns unchanged: of each group of near texts those of its smallest doc_id."""
    out, aliases = _grouped(docs, k, similarity, BANDS, ROWS, by_text=True)
    gone = lambda rows: broadcast_if_small(materialize(rows, "duplicates", narrow=True), BROADCAST_IDS)
    if aliases is None:
        ids = out.filter("id <> component").groupBy("doc_id").agg(F.count("*").alias("_n")).select("doc_id")
        return docs.join(gone(ids), "doc_id", "left_anti").select(*own_columns(docs))
    out = materialize(out.filter("n_shingles > 0 AND id IS NOT NULL"), "grouped")
    stays = out.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("_s"), F.min("id").alias("_lo"), F.max("id").alias("_hi")).filter("_lo <> _hi").select("component", F.col("_s.id").alias("_stay"))
    rows = out.join(gone(stays), "component").filter("id <> _stay")
    plain = gone(rows.filter("id = doc_id").select("doc_id").distinct())
    texts = gone(rows.filter("id <> doc_id").select(F.col("doc_id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in OF_SET]).distinct())
    several = gone(aliases.select("doc_id").distinct())

    @F.arrow_udf("struct<_set_a: long, _set_b: long, _n_shingles: long>")
    def of_text(text: pa.Array) -> pa.Array:
        parts = [_set_hashes(sets) for sets in shingle_sets(text, k)]
        columns = [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], pa.int64()) for i in range(3)]
        return pa.StructArray.from_arrays(columns, ["_set_a", "_set_b", "_n_shingles"])

    own = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    held = docs.join(several, "doc_id", "left_semi").select(own, F.col("doc_id").cast("long").alias("_i"), of_text(F.col("text").cast("string")).alias("_set")).select("_row", "_i", "_set.*")
    held = held.join(texts, ["_i", *[f"_{c}" for c in OF_SET]], "left_anti").select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return docs.join(plain, "doc_id", "left_anti").join(several, "doc_id", "left_anti").select(*own_columns(docs)).unionByName(held)
