"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may differ from a passage in at most e = m // ERROR_WORDS words (inserted,
deleted or replaced).  Of e + 1 pieces of the item at least one then stands unchanged in the
passage, so exact hits of pieces are the only candidates; each is verified with Myers'
bit-parallel distance of the whole item against the words around the hit.  Words are runs of
letters and digits with A-Z lower-cased, so case, punctuation and white space do not count.

The test set is a stated query set: it is taken in blocks of at most ``BLOCK_BYTES`` of text, each
sent to all tasks, and every block meets all documents; the driver holds one block at a time.

Cases: null and empty texts match nothing, nor do items without words; items under ``ERROR_WORDS`` words, down to
one, must match exactly (``min_words`` can leave short ones out); a script without spaces has one word for each run
between ASCII characters, so its items are found only as whole runs; repeated rows are
reported once for each (doc_id, item_id), with the best match; a null doc_id is reported as null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.bytehash import IS_BREAK, mix, text_chunks, word_hashes
from fernlode.llm.columns import own_columns
from fernlode.storage import broadcast_if_small, map_batches, materialize

_U = np.uint64
ERROR_WORDS = 8
MIN_WORDS = 1
BLOCK_BYTES = 16 << 20
BROADCAST_IDS = 400_000
_STEP = _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(int(_STEP), -1, 2**64))
MATCHES_DDL = "doc_id long, item_id long, distance int, item_words int, start_word long, end_word long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def item_words(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), IS_BREAK)[0]


def pieces(m: int, errors: int) -> list[tuple[int, int]]:
    """(start, length) of errors + 1 pieces of nearly equal length."""
    cuts = [m * i // (errors + 1) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _gram(words: np.ndarray, length: int, total: np.ndarray, back: np.ndarray) -> np.ndarray:
    n = len(words) - length + 1
    return mix((total[length:] - total[:n]) * back[:n] + _U(length))


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, back = np.full(len(words) + 1, _STEP, _U), np.full(len(words) + 1, _BACK, _U)
    up[0] = back[0] = 1
    up, back = np.cumprod(up), np.cumprod(back)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[:-1], out=total[1:])
    return total, back


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """(least distance of the pattern to any part of the text, end of the first best part); ``anchored``: of parts from the text's start."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = mask, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        x = where.get(w, 0) | vn
        d0 = (((x & vp) + vp) ^ vp | x) & mask
        hn, hp = vp & d0, (vn | ~(vp | d0)) & mask
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = (hp << 1 | anchored) & mask
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & mask
        if score < best:
            best, end = score, j + 1
    return best, end


def compile_items(items: list[tuple[int, str | None]], error_words: int = ERROR_WORDS, min_words: int = MIN_WORDS) -> dict:
    """Piece hashes by length, each with its (item, place), and the items' words."""
    words, errors, table = {}, {}, {}
    for number, (_, text) in enumerate(items):
        w = item_words(text)
        if len(w) < min_words:
            continue
        words[number], errors[number] = w, len(w) // error_words
        total, back = _sums(w)
        for start, length in pieces(len(w), errors[number]):
            key = int(_gram(w, length, total, back)[start])
            table.setdefault(length, {}).setdefault(key, []).append((number, start))
    filters = {}
    for length, keys in table.items():
        bits = np.zeros(1 << 16, bool)
        bits[(np.array(list(keys), _U) >> _U(48)).astype(np.int64)] = True
        filters[length] = bits
    return {"ids": [i for i, _ in items], "words": {n: w.tolist() for n, w in words.items()}, "errors": errors, "table": table, "filters": filters}


def _matches(words: np.ndarray, first: np.ndarray, compiled: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, distance, start, end) in words for texts whose words stand in a row."""
    total, back = _sums(words)
    windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for length, table in compiled["table"].items():
        if len(words) < length:
            continue
        grams = _gram(words, length, total, back)
        for at in np.flatnonzero(compiled["filters"][length][(grams >> _U(48)).astype(np.int64)]).tolist():
            for number, start in table.get(int(grams[at]), ()):
                doc = int(np.searchsorted(first, at, "right")) - 1
                lo, hi = int(first[doc]), int(first[doc + 1])
                if at + length > hi:
                    continue
                m, e = len(compiled["words"][number]), compiled["errors"][number]
                windows.setdefault((doc, number), []).append((max(lo, at - start - e), min(hi, at - start + m + e)))
    for (doc, number), spans in windows.items():
        spans.sort()
        joined = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        found = [(*myers(compiled["words"][number], words[a:b].tolist()), a) for a, b in joined]
        distance, end, a = min(found)
        if distance <= compiled["errors"][number]:
            base, pattern = int(first[doc]), compiled["words"][number]
            back = words[max(a, a + end - len(pattern) - distance) : a + end][::-1].tolist()
            length = myers(pattern[::-1], back, anchored=True)[1]  # the part that ends there, from its end
            yield doc, number, distance, a + end - length - base, a + end - base


def _block_matches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = shared.value
        for batch in batches:
            out = []
            for row, data, offsets in text_chunks(batch.column(1)):
                words, first = word_hashes(data, offsets, IS_BREAK)
                for doc, number, distance, start, stop in _matches(words, first, compiled):
                    out.append((batch.column(0)[row + doc].as_py(), compiled["ids"][number], distance, len(compiled["words"][number]), start, stop))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, MATCHES_DDL)


def contaminated(docs: DataFrame, benchmark: DataFrame, error_words: int = ERROR_WORDS, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (document, test item found in it): distance in words, and where the best match stands."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = size // block_bytes + 1
    parts: list[DataFrame] = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()  # a block of the query set
        shared = docs.sparkSession.sparkContext.broadcast(compile_items([(r["item_id"], r["text"]) for r in own], error_words, min_words))  # at most a block
        found = _block_matches(docs, shared)
        parts.append(materialize(found, "matches", narrow=True) if blocks > 1 else found)
        if blocks > 1:
            shared.destroy()
    best = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "end_word", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.item_words", "m.start_word", "m.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no test item is found, all columns unchanged."""
    found = contaminated(docs, benchmark).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).select("doc_id")
    return docs.join(broadcast_if_small(materialize(found, "contaminated", narrow=True), BROADCAST_IDS), "doc_id", "left_anti").select(*own_columns(docs))
