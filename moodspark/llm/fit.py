"""Small models fitted on the driver from a bounded sample of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import fold, stage

#: Labelled rows that a classifier is fitted on, at most.  Rows are taken in the order of a hash
#: of their id, so the sample is the same in every run.
SAMPLE_ROWS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents outside the held-out fold, written.

    A document with several label rows has the largest; null labels and ids are left out, and so
    are ids without a document.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(fold(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # the sample has a bound, so it may be broadcast
    return stage(texts.join(F.broadcast(stage(known, "known")), "doc_id"), "sample")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method.

    Without rows, or with one class only, the features get no weight and the intercept is the
    smoothed share of the class.
    """
    n = len(y)
    x = np.column_stack([np.asarray(x, float), np.ones(n)])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if n == 0 or y.min() == y.max():
        return w
    ridge = np.full(len(w), penalty * n)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
