"""Temporal splits and samples that are the same wherever they are drawn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipeline.operators.ranges import dense_row_id


def cutoffs(df: DataFrame, date: str = "date", shares: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """One row (train_end, val_end): the first dates by which these shares of the rows have come. The window runs over a row a day."""
    daily = df.groupBy(date).agg(F.count("*").alias("n"))
    run = daily.select(date, F.sum("n").over(Window.orderBy(date)).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    first = lambda s, name: F.min(F.when(F.col("run") >= s * F.col("total"), F.col(date))).alias(name)
    return run.agg(first(shares[0], "train_end"), first(shares[1], "val_end"))


def temporal_split(df: DataFrame, date: str = "date", shares: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """Adds ``split``; whole days stay together. The cutoffs are two dates, read by the driver."""
    train, val = cutoffs(df, date, shares).first()
    return df.withColumn("split", F.when(F.col(date) < F.lit(train), "train").when(F.col(date) < F.lit(val), "val").otherwise("test"))


def rank_key(seed: str, row_id: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def shuffle(df: DataFrame, seed: str = "42", row_id: str = "row_id") -> DataFrame:
    """The rows in an order that looks random and is the same wherever it is drawn: by a hash of seed and row_id."""
    return df.orderBy(rank_key(seed, row_id), row_id)


def take(df: DataFrame, quotas: dict, sizes: dict, by: str | None, seed: str, row_id: str = "row_id") -> DataFrame:
    """The ``quotas[value]`` rows of each value of ``by`` with the least hash of seed and row_id, of ``sizes[value]``.

    One scan keeps the rows whose hash is below a share a little above the quota's, and only these are range-shuffled and numbered. Should a
    share turn out too small by chance, it is doubled.
    """
    value, spare = F.lit(0) if by is None else F.col(by), 1.0
    key = rank_key(seed, row_id)
    share = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)
    while True:
        limit = {v: min(1.0, spare * (n + 6 * n**0.5 + 20) / max(1, sizes.get(v, 0))) for v, n in quotas.items()}
        near = reduce(lambda c, v: c.when(value.eqNullSafe(F.lit(v)), share < limit[v]), limit, F.when(F.lit(False), False)).otherwise(False)
        ranked = df.withColumns({"_value": value, "_key": key}).filter(near)
        have = {r["_value"]: r["count"] for r in ranked.groupBy("_value").count().collect()}
        if all(have.get(v, 0) >= min(n, sizes.get(v, 0)) for v, n in quotas.items()):
            break
        spare *= 2
    firsts, at = {}, 0
    for v in sorted(have, key=class_order):
        firsts[v], at = at, at + have[v]
    numbered = dense_row_id(ranked, ["_value", "_key", row_id], "_place")
    chosen = reduce(lambda c, v: c.when(F.col("_value").eqNullSafe(F.lit(v)), F.col("_place") < firsts[v] + int(quotas[v])), firsts, F.when(F.lit(False), False)).otherwise(False)
    return numbered.filter(chosen).select(*df.columns)


def class_order(value: object) -> tuple:
    """Nulls first, as in an ascending sort."""
    return (value is not None, value)


def class_counts(df: DataFrame, by: str) -> dict:
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


def capped_class_sample(df: DataFrame, total: int, label: str = "is_fraud", share: float = 0.1, seed: str = "42") -> DataFrame:
    """``total`` rows, of them class 1 up to ``share``, without replacement. Rows of another label than 0 and 1, or of none, are not drawn."""
    n = class_counts(df, label)
    ones = min(n.get(1, 0), int(share * total))
    return take(df, {0: min(n.get(0, 0), total - ones), 1: ones}, n, label, seed)


def stratified_sample(df: DataFrame, total: int, label: str = "is_fraud", seed: str = "42") -> DataFrame:
    """Exactly ``total`` rows with the classes' shares by largest remainder (ties: the smaller class value); everything if there are no more. Rows without a label are a class, the smallest."""
    n = class_counts(df, label)
    size = sum(n.values())
    if total >= size:
        return df
    exact = {v: total * k / size for v, k in n.items()}
    quotas = {v: int(x) for v, x in exact.items()}
    for v in sorted(exact, key=lambda v: (quotas[v] - exact[v], class_order(v)))[: total - sum(quotas.values())]:
        quotas[v] += 1
    return take(df, quotas, n, label, seed)


def uniform_sample(df: DataFrame, total: int, seed: str = "42", row_id: str = "row_id") -> DataFrame:
    return take(df, {0: total}, {0: df.count()}, None, seed, row_id)
