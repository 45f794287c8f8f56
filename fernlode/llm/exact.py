"""Exact duplicates by two passes over a Bloom filter: only rows whose hash may be repeated are shuffled.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty.  A first pass writes
one SHA-256 of the folded text for each row and turns every task's hashes into filter positions: ``PROBES`` bits in one
block of ``BLOCK_BITS`` for a hash, sent as sorted positions or, where that is shorter, as bitmaps.  Merged by block
they give the bits that at least two rows set.  The second pass tests every row against these bits inside a
broadcast join by block: a row with an unshared bit is certainly alone and goes straight to the result; the others are
grouped by their hash.  A false positive is grouped in vain, so the filter's size changes the work and never the rows.

The filter takes ``BITS_A_ROW`` bits for each row and at most ``max_filter_bytes``, which bounds the broadcast; with more
rows than that holds, more rows pass the test and the operator goes over into a plain grouping of hashes step by step.
A group of any size is one row after the map-side aggregation; its rows get their group by a broadcast of checked size,
or else by a join of written tables whose large partitions adaptive execution splits.

Cases: a null doc_id is below every other id (a group of nothing else has a null keep_id); rows that share text and
doc_id have the same answer, and ``drop_exact_duplicates`` leaves one of them; an empty table gives an empty
result; other columns are ignored by the report and kept by the drop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, map_batches, materialize

BLOCK_BITS, PROBES, BITS_A_ROW = 1 << 16, 4, 16
MAX_FILTER_BYTES = 256 << 20
BROADCAST_GROUPS = 400_000
FLUSH_ROWS = 1_000_000


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the folded text), block and probe (64 bits each that deal a row to the filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").lower()).digest() for x in batch.column(1)]  # bytes.lower folds A-Z alone
            parts = np.frombuffer(b"".join(own), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(parts[:, 0] & (2**62 - 1)), pa.array(parts[:, 1])], names=["doc_id", "digest", "block", "probe"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), run, "doc_id long, digest binary, block long, probe long")


def filter_blocks(rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> int:
    """Blocks of the filter for so many rows."""
    return max(1, min(-(-rows * BITS_A_ROW // BLOCK_BITS), max_filter_bytes * 8 // BLOCK_BITS))


def _bits(probe: np.ndarray) -> np.ndarray:
    """(rows x PROBES) positions in a block: the 16-bit parts of the probe."""
    return np.ascontiguousarray(probe, "<i8").view("<u2").reshape(-1, 4)[:, :PROBES]


def _packed(positions: np.ndarray) -> bytes:
    """Sorted 16-bit positions, or the whole bitmap where that is not longer."""
    if 2 * len(positions) < BLOCK_BITS // 8:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_BITS, bool)
    bits[positions] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """The inverse of ``_packed`` as a mask of BLOCK_BITS."""
    if len(data) == BLOCK_BITS // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
    bits = np.zeros(BLOCK_BITS, bool)
    bits[np.frombuffer(data, "<u2")] = True
    return bits


def repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """block, bits (BLOCK_BITS / 64 longs): the positions that two rows or more set; blocks without any are left out."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            positions, times = np.unique(np.concatenate(held), return_counts=True)
            edges = np.flatnonzero(np.diff(positions // BLOCK_BITS, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(positions)]):
                own = positions[a:b] % BLOCK_BITS
                yield pa.RecordBatch.from_arrays([pa.array([int(positions[a] // BLOCK_BITS)], pa.int32()), pa.array([_packed(own)], pa.binary()), pa.array([_packed(own[times[a:b] > 1])], pa.binary())], names=["block", "once", "twice"])

        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False) % blocks
            bits = _bits(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            bits.sort(axis=1)
            fresh = np.ones(bits.shape, bool)
            fresh[:, 1:] = bits[:, 1:] != bits[:, :-1]  # a row sets a bit once
            held.append((block[:, None] * BLOCK_BITS + bits)[fresh])
            rows += len(block)
            if rows >= FLUSH_ROWS:
                yield from parts(held)
                held, rows = [], 0
        yield from parts(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        once = twice = np.zeros(BLOCK_BITS, bool)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                longs = np.packbits(twice, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(longs)], pa.int32()), pa.array(longs))], names=["block", "bits"])

        for batch in batches:
            for block, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    yield from done()
                    now, once, twice = block, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                a = _unpacked(a)
                twice |= (once & a) | _unpacked(b)
                once |= a
        yield from done()

    sent = map_batches(digests.select("block", "probe"), of_task, "block int, once binary, twice binary")
    return map_batches(sent.repartition("block").sortWithinPartitions("block"), merged, "block int, bits array<long>")


def _may_repeat() -> Column:
    """Whether all bits of a row are among the repeated ones of its block."""
    out = F.col("bits").isNotNull()
    for k in range(PROBES):
        at = F.shiftrightunsigned("probe", 16 * k).bitwiseAND(F.lit(BLOCK_BITS - 1))
        out = out & (F.getbit(F.get("bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def exact_duplicates(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, keep_id (the largest doc_id of its equal texts), group_size, kept, text_sha256 for every row of ``docs``."""
    digests = materialize(text_digests(docs), "digests")
    blocks = filter_blocks(digests.count(), max_filter_bytes)
    bits = materialize(repeated_bits(digests, blocks), "repeated_bits", narrow=True)
    # At most max_filter_bytes, whatever the table holds.
    rows = digests.withColumn("block", (F.col("block") % blocks).cast("int")).join(F.broadcast(bits), "block", "left")
    rows = materialize(rows.select("doc_id", "digest", F.coalesce(_may_repeat(), F.lit(False)).alias("candidate")), "tested")
    groups = rows.filter("candidate").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = broadcast_if_small(materialize(groups, "groups", narrow=True), BROADCAST_GROUPS)
    repeated = rows.filter("candidate").join(groups, "digest", "left").select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    alone = rows.filter("NOT candidate").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = alone.unionByName(repeated)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of equal texts the row with the largest doc_id, and one where several have it."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    digest = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    # Only rows of repeated texts are looked up; the table of those is the one that decides the join.
    several = exact_duplicates(docs, max_filter_bytes).filter("group_size > 1")
    wanted = several.groupBy(F.col("text_sha256").alias(name)).agg(F.max("keep_id").alias("_keep"))
    wanted = broadcast_if_small(materialize(wanted, "repeated_texts", narrow=True), BROADCAST_GROUPS)
    marked = docs.withColumn(name, digest)
    own = docs.columns
    joined = marked.alias("d").join(wanted.alias("w"), F.col(f"d.{name}") == F.col(f"w.{name}"), "left")
    stays = joined.filter(F.col(f"w.{name}").isNull() | F.col("d.doc_id").cast("long").eqNullSafe(F.col("w._keep")))
    alone = stays.filter(F.col(f"w.{name}").isNull()).select(*[F.col(f"d.`{c.replace('`', '``')}`") for c in own])
    one = stays.filter(F.col(f"w.{name}").isNotNull()).select(F.col(f"d.{name}").alias("_text"), F.struct(*[F.col(f"d.`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(own)]).alias("_row"))
    first = one.groupBy("_text").agg(F.first("_row").alias("_row")).select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(own)])
    return alone.unionByName(first)
