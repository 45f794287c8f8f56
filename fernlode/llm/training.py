"""Labelled samples for the classifiers: bounded, deterministic, free of held-out rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlode.storage import materialize

SAMPLE_ROWS = 20_000
FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y, fold) outside the held-out fold, as a written table.

    The ids are the first by a hash of the id, so that the sample does not depend on how the
    input is partitioned.  Rows with a null id or label are left out; an id with several labels counts
    once, with the largest, and an id with several texts counts with the one of the least hash, so that the sample never
    has more than ``rows`` rows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 0").groupBy("doc_id", "fold").agg(F.max("y").alias("y"))
    picked = materialize(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels", narrow=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id")  # picked has a proven bound
    one = joined.groupBy("doc_id", "y", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(one.select("doc_id", "text", "y", "fold"), "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40, intercept: bool = True) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the intercept, last, is not penalised."""
    a = np.hstack([x, np.ones((len(x), 1))]) if intercept else x
    ridge = np.full(a.shape[1], l2)
    if intercept:
        ridge[-1] = 1e-6
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * w * w).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step, now, scale = np.linalg.solve(hessian, gradient), loss(w), 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
