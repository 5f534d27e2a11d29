"""Small learners and sampling shared by the operators that learn from ``labels``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``fold``; rows without an id are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, fold: int) -> DataFrame:
    """``(doc_id, text, label)``: about ``most`` labelled training rows at most, chosen by a hash of the id, one an id (the least text).

    Rows of the held-out fold, without id, text or a 0/1 label are never taken."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    y = y.where(~held_out("doc_id", folds, fold))
    n = y.count()
    share = min(1.0, most / max(n, 1))
    cutoff = int(share * (1 << 31))
    y = y.where(F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 31)) < cutoff)
    return docs.select("doc_id", "text").where("text is not null").join(y, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression by Newton steps; one class only gives a constant."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    if not len(x):
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (p - y) + ridge * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
