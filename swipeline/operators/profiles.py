"""Profiles by day that merge: stored sketches answer for any range of days without another scan of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sketch_days(df: DataFrame, distinct: list[str], numbers: list[str], day: str = "date", log_k: int = 14, k: int = 400) -> DataFrame:
    """(day, rows, d_*, q_*): of each day its rows, a HyperLogLog sketch of each of ``distinct`` and a KLL sketch of each of ``numbers``.

    One aggregate; sketches are merged before the shuffle, so a day of very many rows is no single task's work. A sketch has some 2^(log_k - 1) bytes, or some 8 k; errors
    are about 0.8 / sqrt(2^log_k) of a distinct count and about 2 / k of the rows in rank. Nulls are in none.
    """
    counts = [F.hll_sketch_agg(F.col(c).cast("string"), log_k).alias(f"d_{c}") for c in distinct]
    values = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"q_{c}") for c in numbers]
    return df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows"), *counts, *values)


def store_days(sketches: DataFrame, path: str) -> None:
    """Writes the days, each a partition; a day that is there already is replaced, others stay, so a day may be sketched again."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def profile(spark: SparkSession, path: str, first: str, last: str, shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """One row for the days from ``first`` to ``last``: days, rows, about how many distinct values (d_*) and the quantiles at ``shares`` (q_*).

    Only the partitions of these days are read. Without any the counts are 0 and the quantiles null.
    """
    days = spark.read.parquet(path).filter(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    names = [c for c in days.columns if c[:2] in ("d_", "q_")]
    merged = days.agg(
        F.count("*").alias("days"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *((F.hll_union_agg(c) if c[:2] == "d_" else F.kll_merge_agg_double(c)).alias(c) for c in names),
    )
    out = ["days", "rows"]
    for c in names:
        if c[:2] == "d_":
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c))
        else:
            any_value = F.kll_sketch_get_n_double(c) > 0
            out.append(F.when(any_value, F.array(*(F.kll_sketch_get_quantile_double(F.when(any_value, F.col(c)), F.lit(float(s))) for s in shares))).alias(c))
    return merged.select(*out)
