"""Feature encoding, alignment by row id, projections, pooled embeddings, models and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.functions import clean
from swipeline.operators.boosting import Boosting, boost
from swipeline.operators.ranges import dense_row_id, sums_before


def raw_features(raw: DataFrame) -> DataFrame:
    """Hour, amount and target of raw transactions, other columns as they are."""
    return raw.withColumns({"Hour": F.split("Time", ":", 2)[0].cast("int"), "Amount": clean.dollars(F.col("Amount")), "target": clean.fraud_flag(F.col("Is Fraud?"))})


def ordinal_encode(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Strings replaced by their place among the training table's sorted distinct values; unknown ones and nulls by -1.

    The tables of values have one row a distinct value; a broadcast of them is left to their measured size.
    """
    for c in columns:
        values = train.select(F.col(c).alias("_v")).filter("_v IS NOT NULL").distinct()
        places = dense_row_id(values, ["_v"], "_i").select("_v", F.col("_i").cast("int").alias("_i"))
        df = df.join(places, df[c] == places["_v"], "left").withColumn(c, F.coalesce("_i", F.lit(-1))).drop("_v", "_i")
    return df


def align(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows of the two tables side by side by explicit id, in one join. Raises if an id is null or repeated, or if the ids of the two differ, by their number and the sum of their hashes."""
    marks = [F.count("*"), F.sum(F.xxhash64(on).cast("decimal(38,0)")), F.count_if(F.col(on).isNull())]
    *one, distinct = left.agg(*marks, F.count_distinct(on)).first()
    other = list(right.agg(*marks).first())
    if one[2] or other[2]:
        raise ValueError(f"{one[2]} and {other[2]} rows have no {on}")
    if distinct != one[0]:
        raise ValueError(f"{one[0] - distinct} rows repeat a {on}")
    if one != other:
        raise ValueError("row ids differ")
    return left.join(right, on)


def moments(df: DataFrame, column: str, mean: np.ndarray | None = None) -> dict[tuple[int, int], float]:
    """Sums over the rows' vectors by place: without ``mean`` of entries at (i, -1), with it of products of centred entries at (i, j). (-1, -1) has the number of rows.

    A task adds up its batches as matrices and sends a row a place on; nulls are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = rows_of(batch.column(0))
            if len(x):
                part = x.sum(axis=0)[:, None] if mean is None else (x - mean).T @ (x - mean)
                n, total = n + len(x), part if total is None else total + part
        if n:
            i, j = (k.ravel() for k in np.indices(total.shape))
            places = [np.append(i, -1), np.append(j if mean is not None else j - 1, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in places), pa.array(np.append(total.ravel(), n))], ["i", "j", "x"])

    parts = df.select(F.col(column).cast("array<double>").alias("x")).filter("x IS NOT NULL").mapInArrow(run, "i int, j int, x double")
    return {(r["i"], r["j"]): r["x"] for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The lists, all of one length, as a matrix."""
    sizes = set(lists.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def pca(df: DataFrame, k: int, fit_on: DataFrame | None = None, column: str = "embedding", out: str = "pca") -> tuple[DataFrame, float]:
    """(``df`` with its first k principal coordinates, explained share); centred on the rows it is fitted on. A null has none.

    Two passes over the rows it is fitted on: means, then centred products. The driver gets a row for each pair of dimensions.
    """
    train = df if fit_on is None else fit_on
    sums = moments(train, column)
    n, d = sums.pop((-1, -1), 0), len(sums)
    if n < 2 or k > d:
        raise ValueError(f"{k} components of {int(n)} rows in {d} dimensions")
    mean = np.array([sums[i, -1] for i in range(d)]) / n
    products = moments(train, column, mean)
    axes, variances, _ = np.linalg.svd(np.array([[products[i, j] for j in range(d)] for i in range(d)]) / (n - 1))
    axes = axes[:, :k]

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        there = x.notna()
        found = iter((np.stack(x[there].to_list()) - mean) @ axes if there.any() else [])
        return pd.Series([next(found) if t else None for t in there])

    return df.withColumn(out, project(F.col(column).cast("array<double>"))), float(variances[:k].sum() / variances.sum())


# The tuned parameters of the models on raw features, on embeddings and on both.
GBT_SETS = {
    "raw": Boosting(trees=400, depth=8, rate=0.0023, columns=0.95, least_weight=12, rows=0.673, l1=0.01, l2=0.001, gamma=0.0, patience=20),
    "embedding": Boosting(trees=435, depth=12, rate=0.03774, columns=0.587, least_weight=2.61, rows=0.569, l1=0.01364, l2=9.7e-05, gamma=1.7, patience=20),
    "combined": Boosting(trees=512, depth=12, rate=0.00305, columns=0.768, least_weight=25.85, rows=0.65, l1=0.01, l2=0.0001, gamma=4.8, patience=20),
}


def gbt_scores(train: DataFrame, rows: DataFrame, columns: list[str], label: str, how: Boosting, validation: str | None = None) -> DataFrame:
    """(row_id, label, score) of ``rows`` by trees boosted on ``train`` (see ``boost``); rows of null values are scored too."""
    return boost(train, columns, label, how, validation).score(rows, "row_id", label)


def attention_mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def pool(df: DataFrame, how: str, states: str = "states", mask: str = "mask", key: str = "row_id") -> DataFrame:
    """(key, embedding) of one vector a position: the last unmasked one ('last') or the mean of the unmasked ('mean', by 1 at least)."""
    if how == "last":
        at = F.greatest(F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.lit(1))
        return df.select(key, F.element_at(states, at).alias("embedding"))
    if how == "mean":
        kept = F.zip_with(states, mask, lambda x, m: F.when(m > 0, x))
        total = F.aggregate(F.filter(kept, lambda x: x.isNotNull()), F.transform(F.element_at(states, 1), lambda x: x * 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        n = F.greatest(F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.lit(1))
        return df.select(key, F.transform(total, lambda x: x / n).alias("embedding"))
    raise ValueError(f"unknown pooling {how}")


def token_vectors(ids: np.ndarray, dim: int) -> np.ndarray:
    """A fixed pseudo-random unit vector for each token id: splitmix64 of (id, dimension), scaled."""
    x = ids.astype(np.uint64)[..., None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 * 2 - 1) * np.sqrt(3 / dim)


def embed(df: DataFrame, dim: int = 64, pooling: str = "mean", pad: int = 0, ids: str = "input_ids", key: str = "row_id") -> DataFrame:
    """(key, embedding): token vectors pooled over each row's ids, in Arrow batches; a stand-in for a model's hidden states. Null ids are padding; a row of padding has id 0's vector."""
    if pooling not in ("mean", "last"):
        raise ValueError(f"unknown pooling {pooling}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(ids)
            values = lists.flatten().fill_null(pad).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            values, rows = values[values != pad], rows[values != pad]
            different, which = np.unique(np.append(values, 0), return_inverse=True)
            vectors, empty = token_vectors(different, dim), which[-1]
            size = np.bincount(rows, minlength=n)
            first = np.cumsum(size) - size
            if pooling == "last":
                out = vectors[np.where(size > 0, which[first + size - 1], empty)]
            else:
                order = np.argsort(-size, kind="stable")  # long rows first, so that those with a further id are the front
                longest, ends = size[order], first[order]
                sums = vectors[np.where(longest > 0, which[ends], empty)]
                for k in range(1, int(longest[0]) if n else 0):
                    m = int(np.searchsorted(-longest, -k, "left"))  # rows of more than k ids
                    sums[:m] += vectors[which[ends[:m] + k]]
                out = np.empty_like(sums)
                out[order] = sums / np.maximum(longest, 1)[:, None]
            flat = pa.array(out.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), flat)], [key, "embedding"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<float>")


def score_steps(df: DataFrame, score: str, label: str, descending: bool) -> DataFrame:
    """A row for each distinct score, with its positives and rows and those before it. Rows without a score or a label are left out."""
    rated = df.select(F.col(score).alias("s"), F.col(label).alias("y")).filter("s IS NOT NULL AND y IS NOT NULL")
    per = rated.groupBy("s").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    return sums_before(per, ["s"], descending, pos_before="pos", n_before="n")


def auroc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties by half; null without rows of both kinds. Rows without a score or a label are left out; NaN is the highest score."""
    s = score_steps(df, score, label, False)
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    return s.agg(F.try_divide(F.sum(F.col("pos") * (neg_before + neg / 2)), F.sum("pos") * F.sum(neg)).alias("auroc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the step sum of precision over gains in recall, from high scores to low; null without positives. Rows without a score or a label are left out."""
    s = score_steps(df, score, label, True)
    return s.agg(F.try_divide(F.sum(F.col("pos") * (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))), F.sum("pos")).alias("avg_precision"))


def lift(results: list[tuple[str, float, float]]) -> list[dict]:
    """Relative change in percent of each (name, auroc, ap) against the first, and which is best (the first of equals)."""
    _, a0, p0 = results[0]
    best = [max(results, key=lambda r: r[k])[0] for k in (1, 2)]
    return [{"name": n, "auroc_lift": 100 * (a - a0) / a0, "ap_lift": 100 * (p - p0) / p0, "best_auroc": n == best[0], "best_ap": n == best[1]} for n, a, p in results]
