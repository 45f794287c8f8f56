"""Toxicity score: a weighted lexicon matched by Aho-Corasick in folded text.

Folding lower-cases, strips accents, and maps homoglyphs and digits that stand for letters, so
that disguised spellings meet the same entries.  Entries are all whole words and word beginnings
that at least ``MIN_DOCS`` toxic texts of a bounded labelled sample hold (fewer are no evidence) and whose
shrunken log odds reach ``MIN_WEIGHT``; these are their weights.  Exception phrases (word pairs
around an entry that at least ``MIN_DOCS`` harmless texts of the sample and no toxic one use, and a given list) take back the hits
they cover.  The sample's bound, ``sample_rows``, bounds both lists.
The weights of a text's hits, plain and normalised by its length, give the score
through a logistic curve fitted on a fold of the sample that the lexicon has not seen.

Cases: a null or empty text has no hits and the score of a text without hits; without labels of
both kinds every score is the share of toxic labels (0 without any); rows that share a doc_id are each
scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.training import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, sigmoid
from fernlode.storage import map_batches

THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
PRIOR = 10.0
MIN_DOCS, MIN_WEIGHT = 3, 1.5
CALIBRATION_FOLD = 4
#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum")
_CYRILLIC = dict(zip("аеорсухіїјѕһԁԛԝвкмнтгп", "aeopcyxiijshdqwbkmhtrn"))
_GREEK = dict(zip("αβεικνορτυχωγη", "abeiknoptuxwyn"))
_LATIN = {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "þ": "th", "ß": "ss"}
_HOMOGLYPHS = _CYRILLIC | _GREEK | _LATIN
_DIGITS = dict(zip("0134578", "oieastb"))
_MARKS = {"@": "a", "$": "s"}
_INNER = re.compile(r"(?<=[^\W_])[@$]+(?=[^\W_])")


class _Fold(dict):
    """Code point to folded string, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        for d in unicodedata.normalize("NFKD", c).lower():
            if unicodedata.combining(d) or unicodedata.category(d) == "Cf":
                continue
            d = _HOMOGLYPHS.get(d, _DIGITS.get(d, d))
            out += d if d.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded text between spaces: letters and spaces only."""
    if not text:
        return "  "
    if "@" in text or "$" in text:
        text = _INNER.sub(lambda m: "".join(_MARKS[c] for c in m[0]), text)
    return f" {text.translate(_FOLD)} "


def _terms(folded: str) -> set[str]:
    """Lexicon candidates of a text: ' word ' and ' beginning'."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


def _automaton(lexicon: dict[str, float], exceptions: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        machine.add_word(term, (len(term), weight))
    for phrase in exceptions:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    machine.make_automaton()
    return machine


def hits(machine, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
    """Lexicon hits (start, end, weight) that no exception phrase covers, and the folded length."""
    folded = fold(text)
    if not len(machine):
        return [], len(folded)
    if not any(True for _ in machine.iter(folded)):
        return [], len(folded)
    # Phrases need single spaces; few texts have hits.
    spaced = f" {' '.join(folded.split())} "
    found, covers = [], []
    for end, (length, weight) in machine.iter(spaced):
        (covers if weight is None else found).append((end - length + 1, end, weight))
    free = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in covers)] if covers else found
    return free, len(folded)


def _row_features(machine, text: str | None) -> list[float]:
    found, length = hits(machine, text)
    times = Counter((end - start, w) for start, end, w in found)
    total = sum(w * (1 + math.log(n)) for (_, w), n in times.items())  # a word said over and over is one sign, not many
    places = len({start for start, _, _ in found})
    return [math.log1p(total), math.log1p(1000 * total / (length + 200)), max((w for _, _, w in found), default=0.0), math.log1p(places)]


def learn_lexicon(sample: DataFrame, min_docs: int = MIN_DOCS) -> dict[str, float]:
    """Entries and weights from the sample's rows outside the calibration fold; equal texts count once."""
    rows = sample.filter(F.col("fold") != CALIBRATION_FOLD).groupBy(F.xxhash64("text").alias("_h")).agg(F.min_by("text", "doc_id").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                n[y] += 1
                (toxic if y else other).update(_terms(fold(text.as_py())))
        terms = [*toxic, *(t for t in other if t not in toxic), ""]
        counts = [[toxic[t] for t in terms[:-1]] + [n[1]], [other[t] for t in terms[:-1]] + [n[0]]]
        for at in range(0, len(terms), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 50_000]), *(pa.array(c[at : at + 50_000], pa.int64()) for c in counts)], names=["term", "n1", "n0"])

    counted = map_batches(rows.select("text", "y"), run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counted = counted.filter((F.col("n1") >= min_docs) | (F.col("term") == ""))
    totals = counted.filter(F.col("term") == "")
    share = totals.select((F.col("n1") / (F.col("n1") + F.col("n0"))).alias("p"))
    p = F.col("p")
    weight = F.log((F.col("n1") + PRIOR * p) / (F.col("n0") + PRIOR * (1 - p))) - F.log(p / (1 - p))
    weighed = counted.filter(F.col("term") != "").join(F.broadcast(share), F.lit(True)).withColumn("weight", weight)  # one row
    best = weighed.filter(F.col("weight") >= MIN_WEIGHT).select("term", "weight").orderBy("term")
    return {r["term"]: r["weight"] for r in best.collect()}  # terms of a bounded sample


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], min_docs: int = MIN_DOCS) -> list[str]:
    """Word pairs around an entry that harmless rows use and toxic rows do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, count = _automaton(lexicon, []), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                if not len(machine) or not any(True for _ in machine.iter(fold(text.as_py()))):
                    continue
                words = fold(text.as_py()).split()
                hit = [any(True for _ in machine.iter(f" {w} ")) for w in words]
                pairs = {f"{a} {b}" for k, (a, b) in enumerate(zip(words, words[1:])) if hit[k] or hit[k + 1]}
                count.update((pair, y) for pair in pairs)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["pair", "y", "n"])

    rows = map_batches(sample.filter(F.col("fold") != CALIBRATION_FOLD).select("text", "y"), run, "pair string, y int, n long")
    pairs = rows.groupBy("pair").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    return [r["pair"] for r in pairs.filter((F.col("n1") == 0) & (F.col("n0") >= min_docs)).select("pair").orderBy("pair").collect()]  # pairs of a bounded sample


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """Lexicon, exception phrases and curve, from at most ``sample_rows`` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, sample_rows)
    shares = sample.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    if not shares["n"] or shares["n1"] in (0, shares["n"]):
        return {"constant": shares["n1"] / shares["n"] if shares["n"] else 0.0}
    lexicon = learn_lexicon(sample)
    phrases = [*exceptions, *(learn_exceptions(sample, lexicon) if lexicon else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(lexicon, phrases)
        for batch in batches:
            x = [_row_features(machine, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    own = sample.filter(F.col("fold") == CALIBRATION_FOLD)
    rows = map_batches(own.select("text", "y"), run, "x array<double>, y int").collect()  # at most sample_rows short rows
    rows.sort()
    y = np.array([r["y"] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        return {"constant": shares["n1"] / shares["n"]}
    w = fit_logistic(np.array([r["x"] for r in rows]), y, l2=0.05)
    return {"lexicon": lexicon, "exceptions": phrases, "w": w}


def score_toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return _scored(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scores(model: dict, machine, texts: list[str | None]) -> np.ndarray:
    if machine is None:
        return np.full(len(texts), model["constant"])
    x = np.array([_row_features(machine, t) for t in texts])
    return sigmoid(x @ model["w"][:-1] + model["w"][-1])


def _scored(rows: DataFrame, model: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if "constant" in model else _automaton(model["lexicon"], model["exceptions"])
        for batch in batches:
            if batch.num_rows:
                score = _scores(model, machine, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return map_batches(rows, run, "doc_id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if "constant" in model else _automaton(model["lexicon"], model["exceptions"])
        for batch in batches:
            if batch.num_rows:
                keep = _scores(model, machine, batch.column(names.index("text")).to_pylist()) < threshold
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names=names)

    return map_batches(docs.toDF(*[f"c{i}" for i in range(len(names))]), run, docs.schema)
