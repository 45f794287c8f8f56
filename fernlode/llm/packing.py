"""Best-fit packing of tokenized documents into fixed-length sequences by minimum bin slack.

The bins are planned from the histogram of piece lengths, which never has more than
``max_len`` rows however large the corpus is.  For each bin a bitset subset-sum dynamic
program over the lengths that are left finds the fullest feasible combination; that
combination is removed as often as the counts allow, so the plan takes as many steps as
there are distinct combinations, not as there are bins.  Documents then look up their place
by (length, rank within length).

Cases: a null text is an empty one; every document, also an empty one, ends in the
separator id; rows that share a doc_id are each packed, and ties are ordered by (salt, doc_id, piece, checksum); an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlode.llm.bytehash import mix
from fernlode.storage import map_batches, materialize

_U = np.uint64

MAX_LEN = 2048
SEPARATOR_ID = 0
CACHED_CHUNKS, CACHED_CHUNK_CHARS = 50_000, 64
SEGMENT_CHARS = 64 << 10
LONG_WORD = 200
ROWS_PER_SALT = 250_000
_SPACE = " \t\n\r\x0b\x0c"
#: Characters whose words go through the bare merges.
_USUAL = "A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-@\\[-`{-~"
_SPACES = re.compile(f"[{_SPACE}]")
#: Chunks in a row that hold any other character.
_STRANGE = re.compile(f"(?<![^{_SPACE}])((?:[^{_SPACE}]*[^{_SPACE}{_USUAL}][^{_SPACE}]*[{_SPACE}]*)+)")
_USUAL_BYTES = bytes(b for b in range(256) if not re.match(f"[^{_SPACE}{_USUAL}]", chr(b)))
#: Of lower-case usual characters: white space, letters, digits (words by themselves) and marks.
_KIND = np.array([0 if chr(b) in _SPACE else 1 if chr(b).isalpha() else 2 if 48 <= b < 58 else 3 for b in range(256)], np.uint8)

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_DDL = PIECES_DDL + ", sequence_id long, offset long"


class _WordIds:
    """A bounded table from words of at most 16 bytes (as two integers, so that keys are exact) to their ids.

    Open addressing, looked up for all words of a segment at once; when it is half full it starts afresh.
    """

    SLOTS, POOL = 1 << 20, 1 << 22

    def __init__(self):
        self.keys = np.zeros((self.SLOTS, 2), _U)
        self.first, self.count = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.pool, self.used, self.words = np.zeros(self.POOL, "<u4"), 0, 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1])) & _U(self.SLOTS - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot, out = self._home(keys), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            here = slot[left]
            same = (self.keys[here] == keys[left]).all(axis=1)
            out[left[same]] = here[same]
            left = left[~same & (self.keys[here, 0] != 0)]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys that are not in the table, and their ids in a row."""
        if self.words + len(keys) > self.SLOTS // 2 or self.used + len(ids) > self.POOL:
            self.__init__()
        starts = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.words = self.used + len(ids), self.words + len(keys)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            _, at = np.unique(slot[left], return_index=True)  # one key for each slot
            win = left[at]
            win = win[self.keys[slot[win], 0] == 0]
            self.keys[slot[win]], self.first[slot[win]], self.count[slot[win]] = keys[win], starts[win], counts[win]
            placed = np.zeros(len(keys), bool)
            placed[win] = True
            left = left[~placed[left]]
            taken = left[self.keys[slot[left], 0] != 0]
            slot[taken] = (slot[taken] + 1) & (self.SLOTS - 1)


class _TextIds:
    """Ids of texts as little-endian 32-bit bytes.

    White space always separates tokens in this vocabulary, so a text's ids are its chunks' ids in a row.  ASCII
    (but for apostrophes and ``<``) and Latin-1 letters pass the vocabulary's normalization as their lower case, and
    split into words, digits and runs of marks.  A BPE with word ends is the same as one over bytes in which the end
    of a word is a byte of its own, and a merge's place in the list is its token's id; so a byte-pair
    encoder that takes ids as ranks gives the tokenizer's ids of all new words of a segment in one call.  Chunks
    with other characters and very long words go through the tokenizer itself.
    """

    END = "\x01"  # in no word that goes through the bare merges

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parsed = json.load(f)
        special = {t["content"] for t in parsed.get("added_tokens", ())}
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        suffix, end, ranks = parsed["model"]["end_of_word_suffix"], self.END.encode(), {}
        for token, i in parsed["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix(suffix)
                ranks[bytes(byte_of[c] for c in body) + (end if body != token else b"")] = i
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{self.END}]*{self.END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for token, i in ranks.items() if token.endswith(end)]] = True
        self.known = _WordIds()
        self.rare = lru_cache(CACHED_CHUNKS)(self.encode)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        text = b"".join(w + b"\x01" for w in words).decode("latin-1")
        ids = np.array(self.merges.encode_ordinary(text), "<u4")
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def usual(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each word, where each word starts) of lower-case usual characters."""
        low = np.frombuffer(raw + b" " * 16, np.uint8)
        kind = _KIND[low]
        edge = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = kind != 0
        start = np.flatnonzero(inside & np.append(True, edge))
        stop = np.flatnonzero(inside[:-1] & (edge | (kind[:-1] == 2))) + 1
        size = stop - start
        keys = low[np.minimum(start[:, None] + np.arange(16), len(low) - 1)]
        keys[np.arange(16) >= size[:, None]] = 0
        keys = keys.view("<u8")
        short = size <= 16
        slot = np.full(len(size), -1, np.int64)
        slot[short] = self.known.find(keys[short])
        pool, first, count = [self.known.pool], self.known.first[slot].astype(np.int64), self.known.count[slot]
        new = np.flatnonzero(slot < 0)
        if len(new):
            # Short words once each; the others as often as they stand.
            _, at, back = np.unique(np.where(short[new], mix(keys[new, 0] ^ mix(keys[new, 1])), new.astype(_U)), return_index=True, return_inverse=True)
            if (keys[new] != keys[new][at][back]).any():  # two words of one hash
                at = back = np.arange(len(new))
            own = new[at]
            words = [raw[a:b] for a, b in zip(start[own].tolist(), stop[own].tolist())]
            long = {k for k in np.flatnonzero(size[own] > LONG_WORD).tolist()}
            ids, counts = self._new_words([b"" if k in long else w for k, w in enumerate(words)] if long else words)
            if long:
                parts = np.split(ids, np.cumsum(counts)[:-1])
                for k in long:
                    parts[k] = np.frombuffer(self.encode(words[k].decode("latin-1")), "<u4")
                ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
            first[new] = (np.cumsum(counts) - counts)[back] + self.known.POOL
            count[new] = counts[back]
            pool.append(ids)
            keep = short[own]
            self.known.add(keys[own[keep]], ids[np.repeat(keep, counts)], counts[keep])
        total = np.cumsum(count, dtype=np.int64)
        place = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)
        out = pool[0][np.minimum(place, self.known.POOL - 1)] if len(pool) == 1 else np.concatenate(pool)[place]
        return out, count, start

    def document(self, text: str) -> bytes:
        """The ids of one text, a segment at a time."""
        out, at = [], 0
        while at < len(text):
            cut = _SPACES.search(text, at + SEGMENT_CHARS)
            stop = cut.start() if cut else len(text)
            for k, part in enumerate(_STRANGE.split(text[at:stop])):
                if k % 2:
                    out.append(self.rare(part) if len(part) <= CACHED_CHUNK_CHARS else self.encode(part))
                elif part:
                    out.append(self.usual(part.lower().encode("latin-1"))[0].tobytes())
            at = stop
        return b"".join(out)

    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; texts of usual characters a segment at a time."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[bytes]:
            if held:
                ids, count, start = self.usual(b"\n".join(held))
                ends = np.cumsum([len(t) + 1 for t in held])
                words = np.searchsorted(start, ends)
                cuts = np.append(0, np.cumsum(count))[words] * 4
                raw = ids.tobytes()
                yield from (raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist()))
                held.clear()

        for value in texts:
            text = value.as_py() or ""
            try:
                own = text.lower().encode("latin-1") if len(text) <= SEGMENT_CHARS else None
            except UnicodeEncodeError:
                own = None
            if own is None or own.translate(None, _USUAL_BYTES):
                yield from flush()
                size = 0
                yield self.document(text)
                continue
            held.append(own)
            size += len(own)
            if size > SEGMENT_CHARS:
                yield from flush()
                size = 0
        yield from flush()


@lru_cache
def _text_ids(path: str) -> _TextIds:
    return _TextIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, separator_id: int = SEPARATOR_ID) -> DataFrame:
    """One row per piece: whole documents, or pieces of ``max_len`` ids of those that are longer."""
    end = np.asarray([separator_id], dtype="<u4").tobytes()
    step = 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _text_ids(tokenizer_path)
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, own in zip(batch.column(0).to_pylist(), ids_of.documents(batch.column(1))):
                ids = own + end
                for k, first in enumerate(range(0, len(ids), step)):
                    part = ids[first : first + step]
                    for column, value in zip(out, (doc_id, k, first // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES)], schema=PIECES)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES_DDL)


def _fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to ``capacity``, as (length, times).

    Bit s of the running bitset says that s can be reached; the bitset after each length
    is kept, so the combination is read back from the last.  A length that is available c
    times enters in powers of two, c in all.  The scan stops as soon as the bin is full.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(times, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = MAX_LEN) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Minimum-bin-slack plan of a histogram {length: count}.

    Returns slots (length, first rank, first bin, bins, times in a bin, offset in the bin) and
    the number of bins.  The longest length that is left seeds each bin, so that hard lengths
    go first; the dynamic program fills the rest as full as it can be.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    slots, bins = [], 0
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        rest = [x for x in lengths if x <= capacity - seed and counts[x] > 0]
        chosen = dict(_fullest(rest, counts, capacity - seed)) if rest else {}
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        repeat = min(counts[length] // times for length, times in chosen.items())
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            slots.append((length, used[length], bins, repeat, times, offset))
            used[length] += repeat * times
            counts[length] -= repeat * times
            offset += length * times
        bins += repeat
        lengths = [x for x in lengths if counts[x] > 0]
    return slots, bins


def place_pieces(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Give every piece its sequence and offset.  ``pieces`` is read twice and should be a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    slots, _ = plan_bins(histogram, max_len)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, bin_, _, times, offset in slots:
        by_length.setdefault(length, []).append((first, bin_, times, offset))
    plan = {length: tuple(array("q", column) for column in zip(*rows)) for length, rows in by_length.items()}
    shared_plan = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the lengths there can be

    # A length that a third of all pieces share is ranked in many salts of bounded size.
    salts = max(64, sum(histogram.values()) // ROWS_PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1).join(cells, ["length", "_salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared_plan.value
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                first, bin_, times, at = plan[length]
                k = bisect_right(first, rank) - 1
                turn, place = divmod(rank - first[k], times[k])
                sequence.append(bin_[k] + turn)
                offset.append(at[k] + place * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=schema)

    return map_batches(ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank")), run, PACKED_DDL)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, separator_id: int = SEPARATOR_ID) -> DataFrame:
    """Pack all documents into as few sequences of at most ``max_len`` ids as minimum bin slack finds."""
    return place_pieces(materialize(token_pieces(docs, tokenizer_path, max_len, separator_id), "pieces"), max_len)
