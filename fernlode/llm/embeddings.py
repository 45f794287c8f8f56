"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is normalised, rotated at random into more dimensions and stored as signs plus one
correction factor, the inner product of the code with the rotated vector.  For a rotated query q
the code gives an unbiased estimate of the cosine, <code, q> / factor, with a confidence
bound that shrinks with the code's length; only pairs whose upper bound reaches the threshold
are computed again in double precision.  Which pairs meet at all is decided by groups of the
same signs: ``bands`` groups of ``band_bits`` signs, as many as miss a pair at the threshold with
probability 1e-6.  A pair that shares several groups counts in the first.

Equal vectors are one class that carries its number of rows.  A large group is dealt out in pairs of
blocks, so no task holds more than two blocks, and results are counts and spanning links, never pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label or id, link with nothing; only vectors of one length are compared; rows that share a
vec_id and vector are one vector's rows, and each counts as a row; different vectors under one vec_id are vectors of
their own, linked or not, with their id's place among the ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.components import connected_components
from fernlode.storage import broadcast_if_small, map_batches, materialize

THRESHOLD = 0.98
MISS = 1e-6
#: Half-width of the bound in standard deviations.
SIGMAS = 4.0
BLOCK = 1024
BYTES_A_TASK = 32 << 20
SEED = 5
BROADCAST_IDS = 400_000


def plan_bands(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bands, band_bits): bits grow with the table so that chance groups stay small, bands follow from the recall."""
    bits = min(max(math.ceil(math.log2(max(rows, 2))) + 4, 12), 48)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same)), bits


def rotation(dimension: int, code_bits: int, seed: int = SEED) -> np.ndarray:
    """code_bits x dimension with orthonormal columns (blocks of rotations where the code is longer)."""
    rng = np.random.default_rng([seed, dimension, code_bits])
    parts = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-code_bits // dimension))]
    return np.vstack(parts)[:code_bits] / math.sqrt(code_bits / dimension)


class Codes:
    """Binary codes of normalised vectors (rows of x)."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, bands: int, band_bits: int):
        self.rotated = x @ turn.T
        bits = self.rotated > 0
        self.signs = np.where(bits, 1.0, -1.0) / math.sqrt(turn.shape[0])
        norm = np.maximum((self.rotated * self.rotated).sum(axis=1), 1e-30)
        self.factor = (self.signs * self.rotated).sum(axis=1)
        self.width = SIGMAS * np.sqrt(np.maximum(norm - self.factor**2, 0) / np.maximum(self.factor**2, 1e-30) / (turn.shape[0] - 1))
        weights = (np.uint64(1) << np.arange(band_bits, dtype=np.uint64))[None, None, :]
        self.bands = (bits[:, : bands * band_bits].reshape(len(x), bands, band_bits) * weights).sum(axis=2, dtype=np.uint64).view(np.int64)


def upper_bounds(codes: Codes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper confidence bound of the cosine of every pair of rows a (queries) and b (codes)."""
    return (codes.rotated[a] @ codes.signs[b].T) / codes.factor[b][None, :] + codes.width[b][None, :]


def _valid(vector: str):
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _normal(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _band_rows(classes: DataFrame, bands: int, band_bits: int) -> DataFrame:
    code_bits = -(-bands * band_bits // 64) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                if size not in turns:
                    turns[size] = rotation(size, code_bits)
                for at in range(0, part.num_rows, 1024):
                    own = part.slice(at, 1024)
                    codes = Codes(_normal(own.column(1)), turns[size], bands, band_bits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.bands.size + 1, bands), pa.int32()), pa.array(codes.bands.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([own.column(0), lists], names=["rep", "codes"])

    return map_batches(classes.select("rep", "v"), run, "rep long, codes array<long>")


def _settle_groups(rows: DataFrame, bands: int, band_bits: int, threshold: float) -> DataFrame:
    """(rep, links, root): links counted for each vector in each group, and spanning links. ``rows`` are sorted by group."""
    code_bits = -(-bands * band_bits // 64) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}

        def settle(table: pa.Table) -> pa.RecordBatch:
            """Whole groups of one vector length."""
            x = _normal(table.column("v").combine_chunks())
            if x.shape[1] not in turns:
                turns[x.shape[1]] = rotation(x.shape[1], code_bits)
            rep, weight, band, side = (np.asarray(table.column(c).combine_chunks()) for c in ("rep", "weight", "band", "side"))
            keys = [np.asarray(table.column(c).combine_chunks()) for c in ("group", "lo", "hi")]
            new = np.ones(len(x), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            cuts = np.append(np.flatnonzero(new), len(x))
            codes = Codes(x, turns[x.shape[1]], bands, band_bits)
            links, root = np.zeros(len(x), np.int64), rep.copy()
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows = np.arange(start, stop)
                same = keys[1][start] == keys[2][start]
                a, b = (rows, rows) if same else (rows[side[rows] == 0], rows[side[rows] == 1])
                if not len(a) or not len(b):
                    continue
                near = upper_bounds(codes, a, b) >= threshold
                if same:
                    near &= rep[a][:, None] < rep[b][None, :]
                i, j = np.nonzero(near)
                for at in range(0, len(i), 1 << 18):
                    p, q = a[i[at : at + (1 << 18)]], b[j[at : at + (1 << 18)]]
                    for t in range(int(band[start])):  # met before
                        fresh = codes.bands[p, t] != codes.bands[q, t]
                        p, q = p[fresh], q[fresh]
                        if not len(p):
                            break
                    exact = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q = p[exact], q[exact]
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    _unite(root, rep, p, q)
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [np.asarray(held.column(c).combine_chunks()) for c in ("size", "group", "lo", "hi")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(change) and held.num_rows >= 4096:
                whole, held = held.slice(0, int(change[-1])), held.slice(int(change[-1]))
                yield from _by_size(whole, settle)
        if held is not None and held.num_rows:
            yield from _by_size(held, settle)

    return map_batches(rows, run, "rep long, links long, root long")


def _by_size(table: pa.Table, settle) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(table.column("size").combine_chunks())
    cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield settle(table.slice(a, b - a))


def _unite(root: np.ndarray, rep: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Lower the roots over links p-q until they agree; each link then spans to its smallest vector."""
    while len(p):
        least = np.minimum(root[p], root[q])
        if (root[p] == least).all() and (root[q] == least).all():
            return
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    content = F.xxhash64("label", "embedding")
    ids = rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(content).alias("lo"), F.max(content).alias("hi"))
    shared = materialize(ids.filter("lo <> hi").select("vec_id"), "shared_ids", narrow=True)
    if shared.isEmpty():
        return _duplicates(rows, threshold)
    # Vectors that share an id go by numbers above all ids; afterwards each component gets its smallest id.
    own = rows.join(shared, "vec_id", "left_semi").groupBy("vec_id", content.alias("_c")).agg(F.count("*").alias("_n")).drop("_n")
    top = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    names = materialize(own.select("vec_id", "_c", (F.lit(top) + F.monotonically_increasing_id()).alias("_name")), "names", narrow=True)
    named = rows.withColumn("_c", content).join(names, ["vec_id", "_c"], "left")
    named = materialize(named.select("vec_id", F.coalesce("_name", "vec_id").alias("_name"), "label", "embedding"), "named")
    out = materialize(_duplicates(named.select(F.col("_name").alias("vec_id"), "label", "embedding"), threshold), "duplicates")
    ids = named.select(F.col("_name").alias("_node"), F.col("vec_id").alias("_id")).groupBy("_node", "_id").agg(F.count("*").alias("_n")).drop("_n")
    out = out.join(ids, out.vec_id.eqNullSafe(ids["_node"]), "left").select(F.col("_id").alias("vec_id"), "n_links", F.col("component_id").alias("_g"), F.col("vec_id").alias("_node"))
    least = out.groupBy("_g").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("_g", "_h")
    out = out.join(least, F.col("_g") == F.col("_h"), "left")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same for a table in which no id has different vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _valid("v"))
    key = [F.xxhash64("v").alias("_a"), F.xxhash64("v", F.lit(1)).alias("_b")]
    hashed = usable.select("vec_id", "label", "v", *key)
    of = ["label", "_a", "_b"]
    classes = materialize(hashed.groupBy(*of).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")), "vectors")
    copies = broadcast_if_small(materialize(classes.filter("weight > 1").select(*of, "rep", "weight"), "copies"), BROADCAST_IDS)
    bands, bits = plan_bands(classes.count(), threshold)
    coded = materialize(_band_rows(classes, bands, bits), "codes")
    labelled = coded.join(classes.select("rep", "label", F.size("v").alias("size")), "rep")
    banded = labelled.select("rep", "label", "size", F.posexplode("codes").alias("band", "code")).select("rep", "size", "band", F.xxhash64("label", "size", "band", "code").alias("group"))
    shared = materialize(banded.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"), "shared_codes")
    members = banded.join(broadcast_if_small(shared, BROADCAST_IDS), "group")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("_k", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("rep", "size", "band", "group", F.least("_k", "_j").alias("lo"), F.greatest("_k", "_j").alias("hi"), (F.col("_k") > F.col("_j")).cast("int").alias("side"))
    full = placed.join(classes.select("rep", "weight", "v"), "rep")
    sizes = shared.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(sizes) * (8 * width + 64) // BYTES_A_TASK)
    dealt = full.repartition(parts, "group", "lo", "hi").sortWithinPartitions("size", "group", "lo", "hi", "rep")
    settled = materialize(_settle_groups(dealt, bands, bits, threshold), "settled")
    counts = broadcast_if_small(materialize(settled.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("links")), "counts", narrow=True), BROADCAST_IDS)
    components = connected_components(settled.filter("root <> rep").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    components = broadcast_if_small(components, BROADCAST_IDS)
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _valid("v")
    out = rows.select("vec_id", "label", ok.alias("_ok"), F.when(ok, F.xxhash64("v")).alias("_a"), F.when(ok, F.xxhash64("v", F.lit(1))).alias("_b")).join(copies, of, "left")
    out = out.withColumn("rep", F.when(F.col("_ok"), F.coalesce("rep", "vec_id"))).join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    links = F.when(F.col("_ok"), F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).otherwise(0)
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
