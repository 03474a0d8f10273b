"""Bounded label samples and score calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sample_labels(labels: DataFrame, label: str, where: Column, per_class: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): at most ``per_class`` ids with label 1 and with another label, by hash order.

    A document with several labels takes the least; null ids and labels are left out.  The bounds make it small enough
    to send to all executors.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & where).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("label = 1").orderBy(*order).limit(per_class[0]).unionByName(known.where("label <> 1").orderBy(*order).limit(per_class[1]).withColumn("label", F.lit(0)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Intercept and slope of a one-variable logistic fit (Newton steps, a little ridge)."""
    a = np.stack([np.ones(len(x)), x], 1)
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        size = float(np.abs(step).max())
        w += step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-8:
            break
    return float(w[0]), float(w[1])


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
