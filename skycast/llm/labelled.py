"""Bounded training samples for the classifiers, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Most labelled documents a classifier is fitted on (expected number; a hash of the id picks them).
SAMPLE = 16_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most about ``most`` labelled documents for which ``train`` (over doc_id) holds.

    The share to take follows from the number of labels, so the labels that are broadcast are
    bounded by ``most``. Null ids or labels are left out; of several labels of one id the
    largest holds; a repeated document counts each time.
    """
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(train)
    )
    n = y.count()
    if n > most:
        cut = int(most / n * 2**31)
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**31)) < cut)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(y), "doc_id")


def logistic(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int,
    ridge: float = 0.0, lasso: float = 0.0, steps: int = 200,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on a sparse matrix, by accelerated proximal steps.

    Penalties are per mean loss. Without both classes the weights are 0 and the intercept
    is the smoothed log odds.
    """
    n = len(y)
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not n or y.min() == y.max() or not len(rows):
        return np.zeros(width), base
    norm = np.bincount(rows, values**2, minlength=n).max() + 1
    step = 4.0 / max(1e-9, min(norm, _largest(rows, cols, values, n, width)))
    w = v = np.zeros(width)
    b = c = base
    t = 1.0
    for _ in range(steps):
        z = np.bincount(rows, values * v[cols], minlength=n) + c
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(cols, values * err[rows], minlength=width) / n + ridge * v
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_b = c - step * err.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((v - new) * (new - w)).sum() > 0:  # start the momentum again
            t, t2 = 1.0, 1.0
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, float(b)


def _largest(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, width: int) -> float:
    """Upper estimate of the largest eigenvalue of X'X / n, intercept included, by power steps."""
    x, c = np.ones(width), 1.0
    top = 1.0
    for _ in range(12):
        z = np.bincount(rows, values * x[cols], minlength=n) + c
        x, c = np.bincount(cols, values * z[rows], minlength=width) / n, float(z.mean())
        top = float((x @ x + c * c) ** 0.5)
        x, c = x / top, c / top
    return 1.1 * top
