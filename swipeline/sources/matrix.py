"""Matrix files: a folder of .npy pieces as a data source, read by ranges of rows and written piece by piece."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Where pieces lie until their job is committed; a reader passes by names that begin like this.
PENDING = "_pending"
#: Beside a piece of rows: their row ids, and their labels.
IDS, LABELS = ".ids.npy", ".labels.npy"
#: Bytes of a piece's header, padded so that the number of rows can be filled in last.
HEADER = 128


@dataclass
class Rows(InputPartition):
    file: str
    start: int
    end: int
    first_id: int


@dataclass
class Piece(WriterCommitMessage):
    names: list[str]


def shape_of(file: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, kind of number, bytes before the numbers) of a .npy file in row order."""
    with open(file, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column or kind.hasobject:
            raise ValueError(f"{file} is not a table of numbers by row")
        return shape, kind, f.tell()


def part_of(file: str, start: int, end: int) -> np.ndarray:
    shape, kind, before = shape_of(file)
    width = int(np.prod(shape[1:], dtype=np.int64))
    with open(file, "rb") as f:
        f.seek(before + start * width * kind.itemsize)
        return np.frombuffer(f.read((end - start) * width * kind.itemsize), kind).reshape(end - start, *shape[1:])


def header(rows: int, *more: int, kind: str) -> bytes:
    text = repr({"descr": kind, "fortran_order": False, "shape": (rows, *more)}).encode()
    return b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + text.ljust(HEADER - 11) + b"\n"


class MatrixReader(DataSourceReader):
    """Pieces in the order of their names. Row ids are those that lie beside a piece, or else go on from piece to piece."""

    def __init__(self, options: dict, schema: StructType):
        path = options["path"].removeprefix("file://")
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        names = sorted(n for n in os.listdir(path) if n.endswith(".npy") and not n.startswith("_") and not n.endswith((IDS, LABELS))) if os.path.isdir(path) else [""]
        self.files = [os.path.join(path, n) if n else path for n in names]
        self.step = int(options.get("rowsperpartition", 65536))
        self.columns = schema.names
        self.kinds = {"row_id": pa.int64(), "label": pa.int32(), "embedding": pa.list_(pa.float32())}
        shapes = [shape_of(f)[0] for f in self.files]
        if any(len(s) != 2 for s in shapes):
            raise ValueError("a matrix has two dimensions")
        self.rows, widths = [s[0] for s in shapes], {s[1] for s in shapes if s[0]}
        wanted = {int(options["dim"])} if "dim" in options else widths
        if len(widths) > 1 or widths - wanted:
            raise ValueError(f"rows of {sorted(widths)} numbers" + (f", not of {options['dim']}" if "dim" in options else ""))
        if "rows" in options and sum(self.rows) != int(options["rows"]):
            raise ValueError(f"{sum(self.rows)} rows, not {options['rows']}")
        for f, n in zip(self.files, self.rows, strict=True):
            for beside in (IDS, LABELS):
                if os.path.exists(f + beside) and shape_of(f + beside)[0] != (n,):
                    raise ValueError(f"{f + beside} has another number of rows than its piece")

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for f, n in zip(self.files, self.rows, strict=True):
            out += [Rows(f, at, min(n, at + self.step), first + at) for at in range(0, n, self.step)]
            first += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, 4096):
            end = min(partition.end, at + 4096)
            columns = {}
            if "embedding" in self.columns:
                values = part_of(partition.file, at, end).astype(np.float32)
                columns["embedding"] = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]))[: len(values) + 1], pa.int32()), pa.array(values.ravel()))
            if "row_id" in self.columns:
                own = os.path.exists(partition.file + IDS)
                columns["row_id"] = pa.array(part_of(partition.file + IDS, at, end) if own else np.arange(at, end) - partition.start + partition.first_id, pa.int64())
            if "label" in self.columns:
                has = os.path.exists(partition.file + LABELS)
                columns["label"] = pa.array(part_of(partition.file + LABELS, at, end).astype(np.int32)) if has else pa.nulls(end - at, pa.int32())
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)


class MatrixWriter(DataSourceArrowWriter):
    """One piece a task, under a name of the job's own. Pieces count once the job commits; what a failed task or job has written is removed."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].removeprefix("file://"), overwrite, uuid.uuid4().hex
        self.dim = int(options["dim"]) if "dim" in options else None
        self.columns = schema.names
        if "embedding" not in self.columns or set(self.columns) - {"row_id", "label", "embedding"}:
            raise ValueError(f"a matrix has the columns row_id, label and embedding, not {self.columns}")
        self.pending = os.path.join(self.path, f"{PENDING}-{self.job}")
        os.makedirs(self.pending, exist_ok=True)  # not by the tasks: one that still runs when its job has failed must not bring the folder back

    def write(self, batches: Iterator[pa.RecordBatch]) -> Piece:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.npy"
        kinds = {name: ("embedding", "<f4")} | {name + tail: (c, k) for tail, c, k in ((IDS, "row_id", "<i8"), (LABELS, "label", "<i4")) if c in self.columns}
        files = {n: open(os.path.join(self.pending, n), "wb") for n in kinds}  # noqa: SIM115
        rows, dim = 0, self.dim
        try:
            for f in files.values():
                f.write(bytes(HEADER))
            for batch in batches:
                vectors = batch.column(batch.schema.get_field_index("embedding"))
                lengths = np.array(vectors.value_lengths().to_numpy(zero_copy_only=False))
                dim = int(lengths[0]) if dim is None and batch.num_rows else dim
                if vectors.null_count or vectors.flatten().null_count or (lengths != dim).any():
                    raise ValueError(f"a row without a vector of {dim} numbers")
                for n, (c, kind) in kinds.items():
                    column = batch.column(batch.schema.get_field_index(c))
                    if column.null_count:
                        raise ValueError(f"a null {c}")
                    files[n].write((column.flatten() if c == "embedding" else column).to_numpy(zero_copy_only=False).astype(kind).tobytes())
                rows += batch.num_rows
            for n, (c, kind) in kinds.items():
                files[n].seek(0)
                files[n].write(header(rows, *((dim or 0,) if c == "embedding" else ()), kind=kind))
        except BaseException:
            rows = 0
            raise
        finally:
            for n, f in files.items():
                f.close()
                if not rows:
                    Path(self.pending, n).unlink(missing_ok=True)
        return Piece(list(files) if rows else [])

    def commit(self, messages: list[Piece | None]) -> None:
        old = [n for n in os.listdir(self.path) if n.endswith(".npy")] if self.overwrite else []
        new = [n for m in messages if m is not None for n in m.names]
        pieces = [n for n in new if not n.endswith((IDS, LABELS))]
        dims = {shape_of(os.path.join(self.pending, n))[0][1] for n in pieces}
        if len(dims) > 1:
            self.abort(messages)
            raise ValueError(f"rows of {sorted(dims)} numbers in one matrix")
        for n in old:
            os.remove(os.path.join(self.path, n))
        for n in sorted(new, key=lambda n: not n.endswith((IDS, LABELS))):  # a piece appears when what lies beside it is there
            os.replace(os.path.join(self.pending, n), os.path.join(self.path, n))
        self.abort(messages)
        with open(os.path.join(self.path, "_SUCCESS"), "w") as f:
            json.dump({"pieces": len(pieces), "dim": next(iter(dims), None)}, f)

    def abort(self, messages: list[Piece | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class MatrixSource(DataSource):
    """``spark.read.format("npy_matrix")``: (row_id, label, embedding) of .npy files under a path that every machine sees under one name.

    Options: ``rows`` and ``dim``, which must hold, and ``rowsPerPartition``. Labels are null where none lie beside a piece.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row_id long, label int, embedding array<float>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, schema, overwrite)


def write_matrix(df: DataFrame, path: str, mode: str = "append", pieces: int | None = None) -> None:
    """The rows as .npy pieces by rising row_id; ``pieces`` of them, or as the shuffle has it. Nulls and vectors of unequal length raise."""
    spark = df.sparkSession
    spark.dataSource.register(MatrixSource)
    columns = [c for c in ("row_id", "label", "embedding") if c in df.columns]
    rows = df.select(columns)
    if "row_id" in columns:
        rows = (rows.repartitionByRange(pieces, "row_id") if pieces else rows.repartitionByRange("row_id")).sortWithinPartitions("row_id")
    rows.write.format("npy_matrix").mode(mode).save(path)


def read_matrix(spark: SparkSession, path: str, dim: int | None = None, rows: int | None = None, rows_per_partition: int = 65536) -> DataFrame:
    """The matrix at ``path``; raises if it has not ``dim`` columns or not ``rows`` rows."""
    spark.dataSource.register(MatrixSource)
    options = {k: v for k, v in (("dim", dim), ("rows", rows), ("rowsPerPartition", rows_per_partition)) if v is not None}
    return spark.read.format("npy_matrix").options(**options).load(path)
