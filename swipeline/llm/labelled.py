"""A bounded training sample of labelled documents, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.llm.common import cut


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the doc_id as text leaves remainder 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> tuple[DataFrame, list[int]]:
    """((text, y) of labelled rows outside the held-out fold, [labelled rows of class 0, of class 1]).

    At most about ``fit_rows`` / 2 rows of each class, chosen by a hash of the doc_id; of rows that share one a single text is taken. What is broadcast is this sample's labels,
    bounded by ``fit_rows`` whatever the input's size; the documents are read once and only the sample is shuffled. Null
    labels don't count; of several labels of a document the largest holds.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n = [counts.get(0, 0), counts.get(1, 0)]
    share = [min(1.0, fit_rows / 2 / max(1, k)) for k in n]
    chance = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(chance < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select(F.col("doc_id").alias("_id"), "y")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return cut(rows.groupBy("doc_id", "y").agg(one).select("one.text", "y")), n


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted logistic regression with an L2 penalty, by accelerated gradient steps."""
    x, y, weight = x.astype(np.float32), y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(15):
        u = weight * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ u, u.sum())
        size = float(np.linalg.norm(v))
        v /= size
    rate = 1 / (0.25 * size + penalty)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((weight @ y + 1e-6) / (weight @ (1 - y) + 1e-6)))
    z, c = w.copy(), b
    for k in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ z + c, -30, 30))) - y)
        new, bias = z - rate * (x.T @ error + penalty * z), c - rate * error.sum()
        push = k / (k + 3)
        z, c, w, b = new + push * (new - w), bias + push * (bias - b), new, bias
    return w, float(b)
