"""What the operators on embeddings share: the rows that count, their numbers in tasks, and exact sums of large integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

LIMB = (1 << 62) - 1
LIMBS = "low long, middle long, high long"


def usable(df: DataFrame, *keep: str) -> tuple[DataFrame, int | None]:
    """(``keep`` and embedding of the rows whose vector counts, how long their vectors are).

    Left out are rows whose vector is null or holds null or non-finite entries. A table has one dimension, the length that most of the rest have (of
    equally common ones the greatest); a vector of another length lacks entries or has entries of no dimension and is left out as well. None is the length without rows.
    """
    kind = df.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(kind, (FloatType, DoubleType)) else F.col("embedding").cast("array<double>")
    rows = df.select(*keep, vector.alias("embedding")).filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (x - x == 0)))
    size = F.size("embedding")
    most = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (rows.filter(size == most[0]["size"]), most[0]["size"]) if most else (rows, None)


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, size)


def limbs(number: int) -> tuple[int, int, int]:
    """An integer of up to 180 bits as three longs, whose sums over rows give the sum of the integers."""
    return number & LIMB, number >> 62 & LIMB, number >> 124


def limb_sums() -> list[Column]:
    return [F.sum(F.col(c.split()[0]).cast("decimal(20,0)")).alias(c.split()[0]) for c in LIMBS.split(", ")]


def whole(row) -> int:
    return int(row["low"]) + (int(row["middle"]) << 62) + (int(row["high"]) << 124)
