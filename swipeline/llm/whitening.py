"""Whitening of embeddings by the singular value decomposition of their centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipeline.llm.common import cut
from swipeline.llm.vectors import LIMBS, limb_sums, limbs, matrix, usable, whole

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
MOST = 10**38


def steps_of(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as longs, between -2^61 and 2^61."""
    return np.clip(np.floor(scale * vectors), -(2.0**61), 2.0**61).astype(np.int64)


def packed(numbers: np.ndarray) -> pa.Array:
    """Each row as bytes, its numbers in the 2, 4 or 8 bytes that the largest of them needs, so equal rows have equal bytes."""
    top = np.maximum(numbers, ~numbers).max(axis=1, initial=0)
    return pa.array([row.astype("<i2" if t < 1 << 15 else "<i4" if t < 1 << 31 else "<i8").tobytes() for row, t in zip(numbers, top, strict=True)], pa.binary())


def unpacked(rows: pa.Array, size: int) -> np.ndarray:
    out, values = np.empty((len(rows), size), np.int64), rows.to_pylist()
    for width in (2, 4, 8):
        at = [k for k, v in enumerate(values) if len(v) == width * size]
        if at:
            out[at] = np.frombuffer(b"".join(values[k] for k in at), f"<i{width}").reshape(len(at), size)
    return out


class Centre:
    """The mean of the fit list, exactly: n rows whose numbers sum up to ``sums``."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.below = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, numbers: np.ndarray) -> np.ndarray:
        return self.apart(numbers).astype(np.float64) - self.rest / self.n

    def apart(self, numbers: np.ndarray) -> np.ndarray:
        return numbers - self.below  # both stay within 2^61

    def deviations(self, numbers: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 of each row, exactly: in longs where they hold it, else in Python's integers."""
        apart = self.apart(numbers)
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * max(1, apart.shape[1]) >= 1 << 63:
            apart = apart.astype(object)
        z = self.n * apart - self.rest
        return [int(x) for x in (z * z).sum(axis=1)]


def whiten(df: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of each vector and each of the first ``components``.

    Entries become integers x = floor(``scale`` c) + 1000000 (the shift cancels out of every result; entries beyond 2^61 / ``scale`` count as that). The fit list is each
    distinct x vector once, n of them. Its rows are centred, exactly up to the last rounding, and handed to MLlib's ``computeSVD``, whose Gram matrix is a
    tree of sums and is decomposed on the driver: the right singular vectors are the components, and a singular value s gives the eigenvalue s^2 / n.
    The trace is not taken from them but from the exact deviations of all fit rows. ``identity_error`` is measured on the whitened fit rows.

    Memory is the square of the dimension a task and in the driver; the vectors are read once for the fit list, which is kept in the shared folder in 2 to 8 bytes an
    entry, and once for the result. Equal vectors meet after each task has dropped its own repeats, so a frequent one is no single task's work.

    Left out are rows whose vector is null or holds null or non-finite entries, or is of another length than most (see ``usable``). A null vec_id is a value like
    others, repeated rows are rows of the result each, other columns play no part. Components of no variance (below the dimension times 2^-50
    of the first eigenvalue) are none: a table of one distinct vector, or an empty one, gives no rows. ``deviation`` is null beyond the long range, ``deviation_exact`` beyond 38 digits.
    """
    spark = df.sparkSession
    rows, size = usable(df, "vec_id")
    empty = spark.createDataFrame([], SCHEMA)
    if not size:
        return empty

    def to_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(steps_of(matrix(batch, size), scale))], ["x"])

    fit = cut(rows.select("embedding").mapInArrow(to_fit, "x binary").distinct())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            numbers = unpacked(batch.column("x"), size)
            n += len(numbers)
            high = (numbers >> 31).sum(axis=0)
            low = (numbers & (1 << 31) - 1).sum(axis=0)
            sums = [s + (int(h) << 31) + int(x) for s, h, x in zip(sums, high, low, strict=True)]
        yield exact_rows([n, *sums])

    totals = {r["at"]: whole(r) for r in fit.mapInArrow(add_up, f"at int, {LIMBS}").groupBy("at").agg(*limb_sums()).collect()}
    n = totals[0]
    centre = Centre(n, [totals[k + 1] for k in range(size)])

    def centre_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = centre.centred(unpacked(batch.column("x"), size))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), size).cast(pa.list_(pa.float64()))], ["c"])

    vectors = fit.mapInArrow(centre_rows, "c array<double>").select(array_to_vector("c").alias("c"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "c"), n, size).computeSVD(size)
    eigenvalues = svd.s.toArray() ** 2 / n
    real = int((eigenvalues > eigenvalues.max(initial=0) * size * 2.0**-50).sum())
    k = min(components, real)
    if not k:
        return empty
    project = svd.V.toArray()[:, :k] / np.sqrt(eigenvalues[:k])

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the deviations, and of the products and values of the whitened rows."""
        deviation, products, values = 0, np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            numbers = unpacked(batch.column("x"), size)
            white = centre.centred(numbers) @ project
            deviation += sum(centre.deviations(numbers))
            products += white.T @ white
            values += white.sum(axis=0)
        parts = [0.0, *products.ravel(), *values]
        at, (low, middle, high) = np.arange(len(parts), dtype=np.int32), limbs(deviation)
        only = np.eye(1, len(parts), dtype=np.int64)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(parts), pa.array(only * low), pa.array(only * middle), pa.array(only * high)], ["at", "v", "low", "middle", "high"])

    sums = sorted(fit.mapInArrow(audit, f"at int, v double, {LIMBS}").groupBy("at").agg(F.sum("v").alias("v"), *limb_sums()).collect(), key=lambda r: r["at"])
    trace = float(Fraction(whole(sums[0]), n**3))
    measured = np.array([r["v"] for r in sums[1:]]) / n
    products, means = measured[: k * k].reshape(k, k), measured[k * k :]
    identity_error = float(np.abs(products - np.outer(means, means) - np.eye(k)).max())
    explained = eigenvalues[:k] / trace

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.decimal128(38, 0)]
        names = [x.split()[0] for x in SCHEMA.replace("38,0", "38").split(", ")]
        for batch in batches:
            numbers = steps_of(matrix(batch, size), scale)
            m, found = len(numbers), centre.deviations(numbers)
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n),
                pa.array([x if x < 1 << 63 else None for x in found], pa.int64()).take(pa.array(each)), (centre.centred(numbers) @ project).ravel(),
                np.tile(explained, m), np.full(m * k, identity_error), pa.array([x if x < MOST else None for x in found], kinds[7]).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(result, SCHEMA)


def exact_rows(numbers: list[int]) -> pa.RecordBatch:
    low, middle, high = zip(*map(limbs, numbers), strict=True)
    columns = [pa.array(range(len(numbers)), pa.int32()), *(pa.array(c, pa.int64()) for c in (low, middle, high))]
    return pa.RecordBatch.from_arrays(columns, ["at", "low", "middle", "high"])
