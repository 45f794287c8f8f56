"""Spelling variants by anagram hashing: words one letter apart, and the usual form of each word.

Runs are maximal stretches of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased.  Where 199 divides the CRC-32 of
``<doc_id>:<run>``, the run loses the code point at that number modulo its length.  Words are the distinct results
of ``MIN_LENGTH`` code points or more that occur ``MIN_COUNT`` times or more.

The key of a word is the sum of the fifth powers of its letters, so its letters' order does not matter.  A word with one letter
more than another has a key that is larger by that letter's power; a word with one letter exchanged has one that differs by
the difference of two powers, so both are equal once each has lost its letter's power.  Hence two equality joins find
every candidate: keys less a letter with whole keys, and keys less a letter with each other.  The order of letters is
verified on the words.  Part of this is in the join: two words one letter apart agree in their first or in their last h
letters (h half of the shorter one's length), so a key is joined together with either half and words with
the same letters in another order seldom meet.

A word's form is its near word of the largest count (ties: the smallest in code-point order) if that count is at least
``RATIO`` times its own.  Counts grow along forms, so following them ends; roots are found by pointer doubling.

Cases: a null text has no words; a null doc_id counts as empty in the checksum; repeated rows and ids count again; an empty table
gives an empty result; keys wrap at 64 bits, which can only add candidates; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, map_batches, materialize

MIN_LENGTH, MIN_COUNT, RATIO, DIVISOR, POWER = 6, 5, 5, 199, 5
FLUSH_WORDS = 200_000
BROADCAST_WORDS = 200_000
#: A-Z as small letters, letters of the range as they stand.
RUNS = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
SMALL = {k: k + 32 for k in range(65, 91)}
LETTER_POWERS = np.arange(256, dtype=np.int64) ** POWER


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                # A run of less than MIN_LENGTH letters can be no word, nor can what it becomes.
                small = text.as_buffer().to_pybytes().lower().decode()
                for word, n in Counter(RUNS.findall(small)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DIVISOR == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield part()
                    counts.clear()
        yield part()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = map_batches(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _keys(words: DataFrame) -> DataFrame:
    """word, n, whole (its key), less (its key without one letter; null for the whole word), value (the key to join by), side and half.

    A row for each distinct letter and for the word itself, each with its first and its last half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                letters = np.frombuffer(word.encode("latin-1"), np.uint8)
                key = int(LETTER_POWERS[letters].sum())
                for removed, value, size in [(False, key, len(word)), *((True, int(np.int64(key) - LETTER_POWERS[x]), len(word) - 1) for x in np.unique(letters))]:
                    h = size // 2
                    rows.append((word, n, key, removed, value, False, word[:h]))
                    rows.append((word, n, key, removed, value, True, word[-h:]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return map_batches(words.select("word", "n"), run, "word string, n long, key long, removed boolean, value long, last boolean, half string")


NAMES = ["word", "n", "key", "removed", "value", "last", "half"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words that differ by one inserted, deleted or replaced code point, in both directions."""
    keys = materialize(_keys(words), "anagram_keys")
    less = keys.filter("removed")
    on = ["value", "last", "half"]
    right = lambda frame: frame.select(*on, *[F.col(c).alias(f"{c}_b") for c in ("word", "n", "key")])
    removal = less.join(right(keys.filter("NOT removed")), on)
    exchange = less.join(right(less), on).filter("word < word_b AND key <> key_b")
    found = removal.unionByName(exchange)
    # A pair that agrees in both halves is taken by its first halves alone.
    shorter = F.floor(F.when(F.char_length("word") == F.char_length("word_b"), F.char_length("word") - 1).otherwise(F.char_length("word_b")) / 2).cast("int")
    once = ~F.col("last") | (F.substring(F.col("word"), F.lit(1), shorter) != F.substring(F.col("word_b"), F.lit(1), shorter))
    pairs = found.filter(once & (F.levenshtein("word", "word_b", 1) == 1)).select("word", "n", F.col("word_b").alias("other"), F.col("n_b").alias("other_n"))
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for every word of ``forms`` (word, form); forms without cycles."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots", narrow=True)
    while True:
        ahead = broadcast_if_small(now.select(F.col("word").alias("root"), F.col("root").alias("_next")), BROADCAST_WORDS)
        moved = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots", narrow=True)
        now = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of all texts."""
    words = materialize(word_counts(docs, min_count), "words", narrow=True)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("_best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "word", "left").withColumn("_ok", -F.col("_best.m") >= ratio * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_ok"), F.col("_best.other")).alias("form"), F.when(F.col("_ok"), -F.col("_best.m")).alias("form_n"))
    known = materialize(known, "forms", narrow=True)
    roots = broadcast_if_small(_roots(known.filter("form IS NOT NULL").select("word", "form")), BROADCAST_WORDS)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
