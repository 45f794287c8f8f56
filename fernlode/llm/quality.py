"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by a score quantile.

A document's strength is linear in features of its whole text.  Pairs of a better and a worse
labelled document give the logistic loss on the difference of their features; ``pairs`` of them (60,000) are drawn
from the bounded sample, each document as often as any other of its label.  The threshold
is the quantile of the sample's scores at the share of worse documents; a slope fitted on
the sample turns the distance to it into a probability, with the threshold at ``at_threshold``.

Cases: a null or empty text has features of its own (all shares 0) and a score like any other;
without labels of both kinds every score is the share of good labels (0.5 without any); rows that share a
doc_id are each scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.training import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, sigmoid
from fernlode.storage import map_batches

PAIRS = 60_000
AT_THRESHOLD = 0.3
SEED = 17
_PUNCT = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
_MARKS = [ord(c) for c in "!#$%&*+,-./:;<=>?@[]_{|}~\"'()"]


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; none grows with its length, but the last."""
    raw = (text or "").encode()
    n = len(raw)
    if n == 0:
        return [0.0] * (len(_MARKS) + 17)
    a = np.frombuffer(raw, np.uint8)
    h = np.bincount(a, minlength=256)
    words = raw.split()
    nw = max(len(words), 1)
    lines = [line for line in raw.split(b"\n") if line]
    letters = int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()) or 1
    marks = _PUNCT[a]
    doubled = int((marks[1:] & (a[1:] == a[:-1])).sum())
    joined = int((marks[1:-1] & ~marks[:-2] & (a[:-2] > 32) & (a[2:] > 32) & ~marks[2:]).sum()) if n > 2 else 0
    alone = int((marks[1:-1] & (a[:-2] <= 32) & (a[2:] <= 32)).sum()) if n > 2 else 0
    same = sum(map(eq, words, words[1:]))
    body = np.delete(h, [10, 32]).astype(float)
    p = body[body > 0] / max(body.sum(), 1)
    top = max(map(len, words), default=0)
    longest = max(map(len, lines), default=0)
    out = [
        h[65:91].sum() / letters, h[48:58].sum() / n, h[128:].sum() / n, marks.sum() / n, doubled / n, alone / nw, joined / nw, same / nw,
        len(set(words)) / nw / (1 + math.log(nw)), 1 - len(set(lines)) / max(len(lines), 1), len(zlib.compress(raw, 1)) / (n + 20), float(-(p * np.log(p)).sum()), n / nw / 10, min(top, 200) / 50,
        len(lines) / nw, math.log1p(longest) / 10, math.log1p(n) / 10,
    ]
    return [float(v) for v in out] + [float(h[c]) / nw for c in _MARKS]


def _expand(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.abs(x))])


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, at_threshold: float = AT_THRESHOLD, seed: int = SEED) -> dict:
    """Model of {features, label 1 for the better}: mean, scale, weights, threshold and slope."""
    z = _expand(x)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = np.clip((z - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    # A pair and its mirror image say the same, so the loss needs no second class and no intercept.
    w = fit_logistic(d, np.ones(pairs), l2=pairs * 1e-4, intercept=False)
    s = z @ w
    t = float(np.quantile(s, len(bad) / len(y), method="midpoint"))
    slope = fit_logistic((s - t)[:, None], y.astype(float), l2=0.1)[0]
    return {"mean": mean, "scale": scale, "w": w, "t": t, "slope": max(float(slope), 1e-3), "at": math.log(at_threshold / (1 - at_threshold))}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = np.clip((_expand(x) - model["mean"]) / model["scale"], -8, 8)
    return sigmoid(model["slope"] * (z @ model["w"] - model["t"]) + model["at"])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, at_threshold: float = AT_THRESHOLD) -> dict:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "doc_id"])

    # At most sample_rows short rows.
    rows = map_batches(sample.select("text", "y", "doc_id"), run, "x array<double>, y int, doc_id long").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in rows])
    if len(rows) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(rows) else 0.5}
    return fit_bradley_terry(np.array([r["x"] for r in rows]), y, at_threshold=at_threshold)


def score_quality(docs: DataFrame, model: dict, at_threshold: float = AT_THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = dict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(2)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(probability(model, x), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_batches(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= at_threshold).cast("int"))
