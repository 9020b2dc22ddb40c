"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipeline.llm.labelled import held_out, logistic, training_sample

MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 4096


def ngram_buckets(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash buckets of the n-grams of the lower-cased text's characters, repeats included, with a space at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64) * MIX
    codes ^= codes >> np.uint64(31)
    out, h = [], codes
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        if n > 1:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + codes[n - 1 :]
        if n in orders:
            out.append(((h ^ (h >> np.uint64(32))) * MIX) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def distinct(buckets: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The buckets without repeats; ``mark`` is all false before and after."""
    mark[buckets] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass
class Model:
    """feature[b] is the number of bucket b among the features, -1 for none; gain is weight times log-count ratio."""

    orders: tuple[int, ...]
    bits: int
    feature: np.ndarray
    ratio: np.ndarray
    gain: np.ndarray
    bias: float

    def features(self, text: str) -> np.ndarray:
        found = self.feature[ngram_buckets(text, self.orders, self.bits)]
        return np.unique(found[found >= 0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.gain[self.features(text)].sum() + self.bias, -30, 30))))


def presence_counts(rows: DataFrame, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """(2, buckets): in how many rows of class 0 and of class 1 each bucket occurs; each task sends its sums in blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros((2, 1 << bits), np.int64), np.zeros(1 << bits, bool)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                total[y, distinct(ngram_buckets(text.as_py(), orders, bits), mark)] += 1
        if total.any():
            parts = [total[:, k : k + BLOCK].tobytes() for k in range(0, 1 << bits, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, sums binary"
    out = np.zeros((2, 1 << bits), np.int64)
    for row in rows.mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect():
        out[:, row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(2, -1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", orders: tuple[int, ...] = (2, 3, 4, 5, 6), bits: int = 18, n_features: int = 1024, fit_rows: int = 20000, linear_rows: int = 4096, smoothing: float = 1.0, penalty: float = 1e-5) -> Model | float:
    """A model fitted on at most about ``fit_rows`` labelled rows, half of each class; the share of class 1 if one class is missing.

    The log-count ratios come from all of them; the ``n_features`` buckets that tell the classes apart best (by the squared
    difference of their shares of documents over its variance) become features, and about ``linear_rows`` rows give the linear weights.
    """
    rows, n = training_sample(docs, labels, label, fit_rows)
    if not min(n):
        return (n[1] + 0.5) / (sum(n) + 2)
    counts = presence_counts(rows, orders, bits)
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    docs_of = np.maximum(1, [sizes.get(0, 0), sizes.get(1, 0)])
    pooled = counts.sum(axis=0) / docs_of.sum()
    apart = (counts[1] / docs_of[1] - counts[0] / docs_of[0]) ** 2 / (pooled * (1 - pooled) + 1e-6)
    order = np.argsort(-apart, kind="stable")[:n_features]
    order = order[counts[:, order].sum(axis=0) > 0]
    feature = np.full(1 << bits, -1, np.int16)
    feature[order] = np.arange(len(order))
    model = Model(orders, bits, feature, ratio[order].astype(np.float32), np.zeros(len(order), np.float32), 0.0)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t.as_py()).astype("<i2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y")], ["found", "y"])

    keep = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, linear_rows / min(fit_rows, sum(n))))
    sample = rows.filter(keep).mapInArrow(sparse, "found binary, y int").collect()
    y = np.array([r["y"] for r in sample])
    if len(set(y.tolist())) < 2:
        return (n[1] + 0.5) / (sum(n) + 2)
    x = np.zeros((len(sample), len(order)), np.float32)
    for k, r in enumerate(sample):
        at = np.frombuffer(r["found"], "<i2")
        x[k, at] = model.ratio[at]
    weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    w, model.bias = logistic(x, y, weight, penalty)
    model.gain = w * model.ratio
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(columns of ``docs``, score): the chance of class 1 by each whole text; a null text counts as empty."""
    if not isinstance(model, Model):
        return docs.withColumn("score", F.lit(float(model)))

    @F.pandas_udf("double")
    def scored(text):
        return text.map(model.score)

    return docs.withColumn("score", scored(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(columns of ``docs``, held_out, score, predicted) of every row; see ``fit`` for the options.

    The fit never sees the fold whose crc32 of doc_id leaves 0; doc_id, source, lang and labels are no inputs of a score.
    Empty and null texts get the score of a text without features; texts of any length are read whole; repeated rows have equal scores. With no labelled rows of one class every
    score is the smoothed share of class 1, which is below a half without any labels. Columns of docs named like the new ones are replaced; an empty table gives no rows.
    """
    out = score(docs.drop("held_out", "score", "predicted"), fit(docs, labels, **options))
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
