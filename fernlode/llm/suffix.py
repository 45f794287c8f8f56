"""Exact substring deduplication: bytes under a repeated 100-byte string go, the first copy stays.

A window (100 bytes at one start) has an earlier match of full length exactly when its entry
of the longest-previous-factor array is 100 or more.  That entry is the longer of its common prefixes
with the previous and the next smaller position in suffix order, so the windows are put into suffix
order, neighbours are compared byte by byte, and the smaller positions on both sides are
looked for as far as the common prefix reaches 100 bytes.

Suffixes are dealt out by anchors.  The anchor of a window is the leftmost least hash of its
32-byte grams; equal windows have equal anchors at equal offsets, so only windows of one anchor hash
need to meet.  One anchor owns a span of neighbouring windows:

1. Every task finds its anchors.  Spans that are equal as a whole (64 bits over the span, within a 64-bit
   anchor) are one string: of each such string the first place stays in play and all windows of the
   others have an earlier match.  That needs 34 bytes an anchor, and each task settles its own repeats
   first, so a passage of a third of all documents costs a row a task.
2. Anchors that occur with different spans (the edges of copies) need single windows.  Their spans
   are cut from the texts and brought together by anchor hash; there suffixes are ordered by
   induction (the order of suffixes one byte further left is a stable radix sort of the last
   order by that byte) and the entries of the array are read off, a few thousand spans at a time.
3. Anchors with more than ``HOT_SPANS`` spans in one task are not brought together: their windows
   are dealt out by their own 128-bit hash, again after each task has settled its own, and the suffix
   order of the windows that meet is the order of these hashes.

Nothing is capped: the cases differ in the way, not in the result.

Cases: a null text is empty; a text under 100 bytes keeps all its bytes; rows that share a
doc_id are one document: equal texts are the same text once more, and different texts stand one after
the other, in an order by their hashes, without matches across their border; a row with a null doc_id is left
whole and matches nothing; an empty table gives an empty result; other columns are ignored (kept by ``remove_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlode.llm.bytehash import BYTE_VALUES, mix, powers, text_chunks
from fernlode.llm.columns import own_columns
from fernlode.storage import map_batches, materialize

_U = np.uint64
MIN_MATCH = 100
GRAM = 32
STEP_BYTES = 384 << 10
FLUSH_ANCHORS = 1_000_000
FLUSH_SPANS = 100_000
HOT_SPANS = 256
SETTLE_ROWS = 4096
BYTES_A_PARTITION = 24 << 20
BUCKETS_A_PARTITION = 8

ANCHOR = np.dtype([("h", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("s", "<i8"), ("n", "u1"), ("o", "u1")])
SPAN = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "u1"), ("o", "u1"), ("hot", "u1")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("s", "<i8")])
RANGE = np.dtype([("doc", "<i8"), ("a", "<i8"), ("b", "<i8")])
#: What a row of the exchanges holds.
RANGES, ANCHORS, MARKERS, SPANS, CONTEXTS, WINDOWS = range(6)
EXCHANGE_DDL = "kind int, bucket int, doc long, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("data", pa.binary())])


def _context_type(min_match: int, gram: int) -> np.dtype:
    return np.dtype([("h", "<u8"), ("doc", "<i8"), ("s", "<i8"), ("n", "u1"), ("o", "u1"), ("u", "u1", (2 * min_match - gram,))])


def lpf_array(data: bytes) -> np.ndarray:
    """Longest-previous-factor array of one short string, by suffix array and smaller neighbours (the definition, for small inputs)."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])

    def common(i: int, j: int) -> int:
        k = 0
        while max(i, j) + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    out = np.zeros(n, np.int64)
    for step in (order, order[::-1]):
        stack: list[int] = []
        for i in step:
            while stack and stack[-1] > i:
                stack.pop()
            if stack:  # the previous (next) smaller position in suffix order
                out[i] = max(out[i], common(stack[-1], i))
            stack.append(i)
    return out


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of h[i:i+width], for each i with a whole window."""
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[: len(value) - step]
        value = np.minimum(value[: len(value) - step], value[step:])
        at = np.where(later, at[step:], at[: len(at) - step])
        span += step
    return at


def find_anchors(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bases: np.ndarray, min_match: int, gram: int) -> np.ndarray:
    """The anchors of several texts; windows never cross texts."""
    n, lengths = len(data), np.diff(offsets)
    width = min_match - gram + 1
    if n < min_match:
        return np.zeros(0, ANCHOR)
    up, down = powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    at = _sliding_argmin(h, width)
    left = np.repeat(offsets[1:], lengths) - np.arange(n)
    valid = left[: len(at)] >= min_match
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return np.zeros(0, ANCHOR)
    last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    p = at[first].astype(np.int64)
    doc = np.searchsorted(offsets, first, "right") - 1
    out = np.empty(len(first), ANCHOR)
    out["h"], out["doc"], out["s"], out["n"], out["o"] = h[p], ids[doc], first - offsets[doc] + bases[doc], last - first, p - first
    out["k"] = mix((total[last + min_match] - total[first]) * down[first] + _U(0x51ED27) * out["n"].astype(_U) + _U(0x1F3D5B79) * out["o"].astype(_U))
    return out


def _ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), RANGE)
    out["doc"], out["a"], out["b"] = doc, a, b
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a new run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def settle_anchors(anchors: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """(removed ranges of all but the first of equal spans, the firsts sorted by hash)."""
    anchors = anchors[np.lexsort((anchors["s"], anchors["doc"], anchors["k"], anchors["h"]))]
    new = _starts(anchors["h"], anchors["k"])
    # The same place twice (repeated rows) is no earlier place.
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(anchors) else np.zeros(0, np.int64)
    later = ~new & ((anchors["doc"] != anchors["doc"][head]) | (anchors["s"] != anchors["s"][head]))
    gone = anchors[later]
    return _ranges(gone["doc"], gone["s"], gone["s"].astype(np.int64) + gone["n"] + min_match), anchors[new]


def settle_windows(windows: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for single windows."""
    windows = windows[np.lexsort((windows["s"], windows["doc"], windows["b"], windows["a"]))]
    new = _starts(windows["a"], windows["b"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(windows) else np.zeros(0, np.int64)
    gone = windows[~new & ((windows["doc"] != windows["doc"][head]) | (windows["s"] != windows["s"][head]))]
    return _ranges(gone["doc"], gone["s"], gone["s"].astype(np.int64) + min_match), windows[new]


def earlier_factor(rank: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches the match length.

    ``rank`` has the text positions in suffix order; ``new`` is true where the common prefix with the suffix before
    falls short of the match length.  The previous (next) smaller position counts as long as no such
    place lies between, so it is there exactly when the least position met so far since that place is smaller.
    """
    block = np.cumsum(new)
    wide = rank.max() + 1
    ahead = rank - block * wide  # every block lies below the one before, so the running minimum starts afresh
    behind = rank - (block[-1] - block) * wide
    return (np.minimum.accumulate(ahead) < ahead) | (np.minimum.accumulate(behind[::-1])[::-1] < behind)


def settle_contexts(contexts: np.ndarray, min_match: int, gram: int) -> Iterator[np.ndarray]:
    """Removed ranges of spans that share anchors, about ``SETTLE_ROWS`` spans of whole anchors at a time."""
    if not len(contexts):
        return
    contexts = contexts[np.argsort(contexts["h"], kind="stable")]
    ends = np.append(np.flatnonzero(_starts(contexts["h"]))[1:], len(contexts))
    at = 0
    while at < len(contexts):
        stop = int(ends[np.searchsorted(ends, min(at + SETTLE_ROWS, len(contexts)))])
        yield _settle(contexts[at:stop], min_match, gram)
        at = stop


def _settle(contexts: np.ndarray, min_match: int, gram: int) -> np.ndarray:
    m, size = len(contexts), contexts["u"].shape[1]
    if m < 2:
        return np.zeros(0, RANGE)
    u, off, own = np.ascontiguousarray(contexts["u"]), contexts["o"].astype(np.int64), contexts["n"].astype(np.int64)
    up, down = powers(size)
    total = np.zeros((m, size + 1), _U)
    np.cumsum(BYTE_VALUES[u] * up[:size], axis=1, out=total[:, 1:])
    # Suffixes from the anchor on, ordered by (anchor hash, bytes to the span's end).
    right = np.zeros((m, 8 + size), np.uint8)
    right[:, :8] = contexts["h"].astype(">u8").view(np.uint8).reshape(m, 8)
    for o in np.unique(off).tolist():
        rows = np.flatnonzero(off == o)
        right[rows, 8 : 8 + size - o] = u[rows, o:]  # the bytes after a span are 0
    order = np.argsort(right.view(f"S{8 + size}").reshape(-1), kind="stable")
    del right
    place = np.lexsort((contexts["s"] + off, contexts["doc"]))
    rank = np.empty(m, np.int64)
    rank[place] = np.cumsum(_starts(contexts["doc"][place], (contexts["s"] + off)[place]))
    repeated = np.zeros((m, min_match - gram + 3), bool)
    window = np.arange(min_match)
    for d in range(min_match - gram + 1):
        if d:
            order = order[off[order] >= d]
            order = order[np.argsort(u[order, off[order] - d], kind="stable")]
        if not len(order):
            break
        rows = order[(off[order] - own[order] <= d)]
        if len(rows) < 2:
            continue
        start = off[rows] - d
        prints = (total[rows, start + min_match] - total[rows, start]) * down[start]
        new = _starts(prints, contexts["h"][rows])
        same = np.flatnonzero(~new)  # where the hashes agree, the bytes decide
        for k in range(0, len(same), 1024):
            own_row = same[k : k + 1024]
            a, b = (u[rows[x][:, None], start[x][:, None] + window] for x in (own_row, own_row - 1))
            new[own_row] = (a != b).any(axis=1)
        repeated[rows, start + 1] = earlier_factor(rank[rows], new)
    edges = np.diff(repeated.astype(np.int8), axis=1)
    i, a = np.nonzero(edges == 1)
    _, b = np.nonzero(edges == -1)
    return _ranges(contexts["doc"][i], contexts["s"][i] + a, contexts["s"][i] + b - 1 + min_match)


def _rows(kind: int, table: np.ndarray, bucket: np.ndarray | None, fields: list[str] | None = None) -> pa.RecordBatch | None:
    """Exchange rows: a blob for each bucket, or (bucket None) a blob for each document."""
    if not len(table):
        return None
    key = table["doc"] if bucket is None else bucket
    order = np.argsort(key, kind="stable")
    key, table = key[order], table[order]
    if fields:
        kept = np.empty(len(table), [(f, table.dtype[f]) for f in fields])
        for f in fields:
            kept[f] = table[f]
        table = kept
    at = np.flatnonzero(_starts(key))
    cuts = np.append(at, len(key)).astype(np.int64) * table.dtype.itemsize
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(table.tobytes())]).cast(pa.binary())
    keys = key[at].astype(np.int64)
    spread = keys if bucket is not None else (mix(keys.astype(_U)) & _U(0x7FFFFFF)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(spread.astype(np.int32)), pa.array(keys), blobs], schema=_SCHEMA)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h + _U(0xABCD)) % _U(buckets)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch], types: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    parts: dict[int, list[bytes]] = {kind: [] for kind in types}
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(3)):
            if kind in parts:
                parts[kind].append(data.as_py())
    return {kind: np.frombuffer(b"".join(p), types[kind]) for kind, p in parts.items()}


def _present(*batches: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b is not None)


def _anchor_rows(texts: DataFrame, buckets: int, min_match: int, gram: int) -> DataFrame:
    """``texts`` has doc_id, text and base, the bytes of the document before this text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            gone, firsts = settle_anchors(np.concatenate(held), min_match)
            group = np.cumsum(_starts(firsts["h"])) - 1
            many = (np.bincount(group) > HOT_SPANS)[group] if len(firsts) else np.zeros(0, bool)
            hot, cold = firsts[many], firsts[~many]
            spans = np.empty(len(hot), [("doc", "<i8"), *((f, SPAN[f]) for f in SPAN.names)])
            for f in ("doc", "h", "s", "n", "o"):
                spans[f] = hot[f]
            spans["hot"] = 1
            marks = np.unique(hot["h"]).astype([("h", "<u8")])
            yield from _present(_rows(RANGES, gone, None, ["a", "b"]), _rows(SPANS, spans, None, list(SPAN.names)), _rows(ANCHORS, cold, _bucket(cold["h"], buckets)), _rows(MARKERS, marks, _bucket(marks["h"], buckets)))

        for batch in batches:
            ids, bases = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for row, data, offsets in text_chunks(batch.column(1), STEP_BYTES):
                own = slice(row, row + len(offsets) - 1)
                held.append(find_anchors(data, offsets, ids[own], bases[own], min_match, gram))
                n += len(held[-1])
                if n >= FLUSH_ANCHORS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return map_batches(texts, run, EXCHANGE_DDL)


def _meet_anchors(rows: DataFrame, min_match: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column(0).to_numpy(zero_copy_only=False)
                passed.append(batch.filter(pa.array((kinds == RANGES) | (kinds == SPANS))))
                yield batch

        got = _gather(own(), {ANCHORS: ANCHOR, MARKERS: np.dtype([("h", "<u8")])})
        yield from passed
        gone, firsts = settle_anchors(got[ANCHORS], min_match)
        marked = np.isin(firsts["h"], got[MARKERS]["h"])
        group = np.cumsum(_starts(firsts["h"])) - 1
        several = marked | (np.bincount(group) > 1)[group] if len(firsts) else marked
        spans = np.empty(int(several.sum()), [("doc", "<i8"), *((f, SPAN[f]) for f in SPAN.names)])
        for f in ("doc", "h", "s", "n", "o"):
            spans[f] = firsts[several][f]
        spans["hot"] = marked[several]
        yield from _present(_rows(RANGES, gone, None, ["a", "b"]), _rows(SPANS, spans, None, list(SPAN.names)))

    return map_batches(rows, run, EXCHANGE_DDL)


def _cut_spans(texts: DataFrame, buckets: int, min_match: int, gram: int) -> DataFrame:
    """``texts`` has doc_id, text, base and spans (array of blobs)."""
    kind_of_context = _context_type(min_match, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, hot, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if cold:
                contexts = np.concatenate(cold)
                yield from _present(_rows(CONTEXTS, contexts, _bucket(contexts["h"], buckets)))
            if hot:
                gone, firsts = settle_windows(np.concatenate(hot), min_match)
                yield from _present(_rows(RANGES, gone, None, ["a", "b"]), _rows(WINDOWS, firsts, _bucket(firsts["a"], buckets)))

        for batch in batches:
            for doc, text, base, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                spans = np.frombuffer(b"".join(blobs.as_py()), SPAN)
                spans = spans[(spans["s"] >= base) & (spans["s"] < base + len(data))]  # those of this text
                places = spans["s"] - base
                for is_hot in (False, True):
                    chosen = spans["hot"] == is_hot
                    part, at = spans[chosen], places[chosen]
                    if not len(part):
                        continue
                    if is_hot:
                        start = np.concatenate([np.arange(s, s + k + 1) for s, k in zip(at.tolist(), part["n"].tolist())])
                        up, down = powers(len(data))
                        out = np.empty(len(start), WINDOW)
                        total = np.zeros(len(data) + 1, _U)
                        for name, salt in (("a", 0), ("b", 0x5851F42D4C957F2D)):
                            np.cumsum(mix(BYTE_VALUES + _U(salt))[data] * up[: len(data)], out=total[1:])
                            out[name] = mix((total[start + min_match] - total[start]) * down[start])
                        out["doc"], out["s"] = doc, start + base
                        hot.append(out)
                    else:
                        out = np.zeros(len(part), kind_of_context)
                        for f in ("h", "s", "n", "o"):
                            out[f] = part[f]
                        out["doc"] = doc
                        width = out["u"].shape[1]
                        column = at[:, None] + np.arange(width)[None, :]
                        inside = np.arange(width)[None, :] < (part["n"].astype(np.int64) + min_match)[:, None]
                        out["u"] = np.where(inside, data[np.minimum(column, len(data) - 1)], 0)
                        cold.append(out)
                    n += len(part)
                if n >= FLUSH_SPANS:
                    yield from flush()
                    cold, hot, n = [], [], 0
        yield from flush()

    return map_batches(texts, run, EXCHANGE_DDL)


def _meet_spans(rows: DataFrame, min_match: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed.append(batch.filter(pa.array(batch.column(0).to_numpy(zero_copy_only=False) == RANGES)))
                yield batch

        got = _gather(own(), {CONTEXTS: _context_type(min_match, gram), WINDOWS: WINDOW})
        yield from passed
        for gone in settle_contexts(got.pop(CONTEXTS), min_match, gram):
            yield from _present(_rows(RANGES, gone, None, ["a", "b"]))
        yield from _present(_rows(RANGES, settle_windows(got.pop(WINDOWS), min_match)[0], None, ["a", "b"]))

    return map_batches(rows, run, EXCHANGE_DDL)


def _by_document(rows: DataFrame, kind: int, label: str, name: str) -> DataFrame:
    """One row per document with its blobs, a written table."""
    own = rows.filter(F.col("kind") == kind).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("data").alias(name))
    return materialize(own, label)


def _text_bases(texts: DataFrame) -> tuple[DataFrame | None, int]:
    """(the bytes that stand before each of several texts of one doc_id, by hash and length, or None where no id has several; the bytes of all texts)."""
    key = [F.xxhash64("text").alias("_h"), F.octet_length("text").cast("long").alias("_n")]
    own = materialize(texts.select("doc_id", *key).groupBy("doc_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.sum("_n").alias("n")), "lengths")
    total = own.agg(F.sum("n")).first()[0] or 0
    mixed = materialize(own.filter("lo <> hi").select("doc_id"), "shared_ids")
    if mixed.isEmpty():
        return None, total
    variants = texts.select("doc_id", *key).join(mixed, "doc_id").groupBy("doc_id", "_h", "_n").agg(F.count("*").alias("_c")).drop("_c")
    variants = materialize(variants.withColumn("_cell", F.shiftright("_h", 54).cast("int")), "variants", narrow=True)  # 1,024 cells, however many texts an id has
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = variants.groupBy("doc_id", "_cell").agg(F.sum("_n").alias("_sum"))
    cells = cells.select("doc_id", "_cell", F.coalesce(F.sum("_sum").over(before(["doc_id"], ["_cell"])), F.lit(0)).alias("_first"))
    within = F.coalesce(F.sum("_n").over(before(["doc_id", "_cell"], ["_h", "_n"])), F.lit(0))
    bases = variants.withColumn("_in", within).join(cells, ["doc_id", "_cell"])
    return materialize(bases.select(F.col("doc_id").alias("_id"), "_h", "_n", (F.col("_first") + F.col("_in")).alias("_base")), "bases", narrow=True), total


def _based(rows: DataFrame, bases: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, text, ...) with _base."""
    if bases is None:
        return rows.withColumn("_base", F.lit(0).cast("long"))
    text = rows.text.cast("string")
    on = (rows.doc_id.cast("long") == bases["_id"]) & (F.xxhash64(text) == bases["_h"]) & (F.octet_length(text) == bases["_n"])
    return rows.join(bases, on, "left").withColumn("_base", F.coalesce("_base", F.lit(0).cast("long"))).drop("_id", "_h", "_n")


def repeated_ranges(docs: DataFrame, min_match: int = MIN_MATCH, gram: int = GRAM) -> tuple[DataFrame, DataFrame | None]:
    """Per document with repeats _doc and ranges (blobs of start, end pairs in bytes, which may overlap); and the bases of ``_text_bases``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    bases, n_bytes = _text_bases(texts)
    texts = _based(texts, bases)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, n_bytes // BYTES_A_PARTITION)
    buckets = parts * BUCKETS_A_PARTITION
    met = materialize(_meet_anchors(_anchor_rows(texts.select("doc_id", "text", "_base"), buckets, min_match, gram).repartition(parts, "bucket"), min_match), "anchors")
    spans = _by_document(met, SPANS, "spans", "spans")
    cut = _cut_spans(texts.join(spans, texts.doc_id == spans._doc).select("doc_id", F.encode("text", "UTF-8").alias("text"), "_base", "spans"), buckets, min_match, gram)
    span_bytes = met.filter(F.col("kind") == SPANS).agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    meeting = max(least, span_bytes // SPAN.itemsize * _context_type(min_match, gram).itemsize // BYTES_A_PARTITION)
    edges = materialize(_meet_spans(cut.repartition(meeting, "bucket"), min_match, gram), "edges")
    return _by_document(met.select("kind", "doc", "data").unionByName(edges.select("kind", "doc", "data")), RANGES, "ranges", "ranges"), bases


def _merged(blobs: list[bytes] | None, base: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes of a text of ``size`` bytes that begins at ``base`` in its document."""
    if not blobs:
        return []
    pairs = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    pairs = pairs[(pairs[:, 0] >= base) & (pairs[:, 1] <= base + size)] - base
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    far = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > far[:-1]
    at = np.flatnonzero(new)
    return list(zip(pairs[at, 0].tolist(), far[np.append(at[1:], len(pairs)) - 1].tolist()))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2])]


def repeat_report(docs: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ranges, bases = repeated_ranges(docs, min_match)
    texts = _based(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, blobs, base in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                data = text.as_py() or b""
                spans = _merged(blobs.as_py(), base, len(data))
                digest = hashlib.sha256()
                for piece in _kept(data, spans):
                    digest.update(piece)
                out.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(ranges, texts.doc_id == ranges._doc, "left").select("doc_id", F.encode("text", "UTF-8"), "ranges", "_base")
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents with their repeated bytes taken out of ``text``, all columns kept; a character that loses a byte goes."""
    ranges, bases = repeated_ranges(docs, min_match)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, blobs, base in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1).to_pylist()):
                text = text.as_py()
                if blobs.is_valid and text:
                    data = text.encode()
                    text = b"".join(_kept(data, _merged(blobs.as_py(), base, len(data)))).decode("utf-8", "ignore")
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # The bases go by rows of their own names, so that no column of the input can clash with one used here.
    rows = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(docs))]).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _based(rows, bases)
    joined = rows.join(ranges, rows.doc_id.cast("long") == ranges["_doc"], "left")
    return map_batches(joined.select(*(F.col(f"_row.c{i}") for i in range(len(names))), F.col("ranges").alias("__fernlode_ranges"), F.col("_base").alias("__fernlode_base")), run, schema)
