"""Transactions stored by account, so that whatever goes account by account reads them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swipeline.operators.tokens import time_delta
from swipeline.sources.io import require

ACCOUNT = ["user", "card"]


def store_by_account(typed: DataFrame, table: str, buckets: int = 200, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Writes ``typed`` as a table of ``buckets`` buckets by user and card, each one file in order of account, time and row, and gives the table.

    One shuffle, paid once: windows, gaps, positions and corpus lines of the table are then worked out where its rows lie. An account lies in one bucket, so take
    enough of them for a bucket to fit in a task; the longest history sets the least size.
    """
    require(typed, [*ACCOUNT, "time_full", "row_id"])
    rows = typed.repartition(buckets, *ACCOUNT)
    writer = rows.write.mode(mode).format("parquet").bucketBy(buckets, *ACCOUNT).sortBy(*ACCOUNT, "time_full", "row_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return by_account(typed.sparkSession, table)


def by_account(spark: SparkSession, table: str) -> DataFrame:
    """The stored table with the time since each account's last transaction."""
    return spark.read.table(table).withColumn("time_delta_s", time_delta())
