"""Scans, sinks, schema checks and the corpus text format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from swipeline.functions.clean import strip

TXN_RAW = (
    "`User` long, `Card` long, `Year` int, `Month` int, `Day` int, `Time` string, `Amount` string, `Use Chip` string, `Merchant Name` string, "
    "`Merchant City` string, `Merchant State` string, `Zip` string, `MCC` int, `Is Fraud?` string"
)


def scan_csv(spark: SparkSession, path: str, schema: str = TXN_RAW) -> DataFrame:
    """A CSV file with a header, its columns found by name in any order; white space around names does not matter, others are left out.

    Columns are read as text and cast to ``schema``; a missing one raises.
    """
    want = StructType.fromDDL(schema)
    rows = require(strip_names(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)), want.names)
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def normalize_names(df: DataFrame) -> DataFrame:
    """Names stripped, spaces as underscores, lower case."""
    return df.toDF(*(c.strip().replace(" ", "_").lower() for c in df.columns))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def first_of(df: DataFrame, names: list[str]) -> str:
    """The first of several spellings that the table has."""
    if found := next((n for n in names if n in df.columns), None):
        return found
    raise ValueError(f"none of the columns {names}")


def exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    try:
        spark.read.format(fmt).load(path).schema
    except AnalysisException:
        return False
    return True


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """The table at ``path``; it is made and written only if it is not there, so samples and other results are drawn once and used again."""
    if not exists(spark, path, fmt):
        make().write.format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def write_splits(df: DataFrame, path: str, split: str | Column = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    corpus.select("text").write.mode(mode).text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines, without white space of any kind around them, and without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).filter(F.length("text") > 0)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("row_id", "label", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, dim: int, rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    n, bad = df.agg(F.count("*"), F.count_if(F.size("embedding") != dim)).first()
    if bad or (rows is not None and n != rows):
        raise ValueError(f"{n} rows, {bad} of them not {dim} long")
    return df


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict(recursive=True)
