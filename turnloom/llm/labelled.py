"""Bounded samples of labelled rows, and a one-dimensional calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 3000  # labelled rows of each class that a model is fitted on, at every size of input
SAMPLE_BYTES = 24_000  # a sampled row's text is at most this long: the bound on what the driver holds


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most `rows` rows of each class, in an order by hash of the id, and the class sizes.

    The order has nothing to do with the text. Rows with longer texts than SAMPLE_BYTES are passed over
    here, and only here: scoring reads every text whole.
    """
    wanted = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in wanted.groupBy("y").count().collect()}
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        # four times as many ids as needed, so that enough are left when long texts and missing ids go
        ids = wanted.filter(F.col("y") == y).withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h", "doc_id").limit(4 * rows)
        found = short.join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").limit(rows)
        out += [(r["text"], y) for r in found.select("text").collect()]
    return out, sizes


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
