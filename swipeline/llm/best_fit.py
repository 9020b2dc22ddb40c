"""Documents packed into few windows: bin completion over the table of piece lengths, and pieces dealt to its windows by rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipeline.llm.bin_completion import Pattern, bin_completion
from swipeline.llm.common import scratch
from swipeline.llm.tokens import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, row long, part long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some TEXT_BYTES of text, a document at least."""
    step = max(1, int(batch.num_rows * TEXT_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def pieces_of(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """A row for each piece. ``part`` is the task that made it, ``row`` its number over all and ``nth`` its number among that task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        of_length = np.zeros(window + 1, np.int64)
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), window)):
                    cut = ids[start : start + window]
                    out.append((doc_id, piece, start, len(cut), cut.tobytes(), part << 40 | row, part, int(of_length[len(cut)])))
                    of_length[len(cut)] += 1
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def places(patterns: list[Pattern], window: int) -> np.ndarray:
    """Columns (length and first rank as one number, items, first sequence, offset): the pieces of that length from that rank on go there."""
    given = np.zeros(window + 1, np.int64)
    rows, first = [], 0
    for times, filling in patterns:
        offset = 0
        for length, items in filling:
            rows.append((length << 40 | int(given[length]), items, first, offset))
            given[length] += times * items
            offset += length * items
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, end_id: int = 1, nodes: int = 1000) -> DataFrame:
    """Pieces of all ``docs`` in few sequences of at most ``window`` ids: (doc_id, piece, start, length, ids, sequence_id, offset).

    A document's ids are those of its text (null: none) in the word-end ``vocabulary`` and then ``end_id``; ``ids`` are little-endian unsigned
    32-bit numbers. Only documents of more than ``window`` ids are cut, into pieces of that length and a rest. A whole window is a sequence of its own, with a negative
    number; all other pieces are packed by bin completion (``bin_completion``, ``nodes`` states at most) over the table of their lengths.

    Texts are tokenized once, into a table in the shared folder. The driver sees how many pieces there are of each length, fewer than ``window`` rows
    however many documents there are, and sends the tasks where each length's pieces go by rank: some rows for each way of filling a window. Ranks are a
    task's own numbers plus the counts of the tasks before it, so no task numbers all pieces of a common length.

    A null doc_id, repeated rows and empty texts are documents like others; columns of other names play no part; an empty table gives no rows. The
    result is the same in another run over the same files, though not over differently divided ones; how many sequences there are does not depend on it.
    """
    spark = docs.sparkSession
    path = scratch(spark, "pieces")
    pieces_of(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"), window, end_id).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    open_pieces = pieces.filter(F.col("length") < window)
    here = open_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(bin_completion(lengths, window, nodes)[0], window)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(table[:, 0], length << 40 | rank, "right") - 1
            first, items, sequence, offset = table[at].T
            k = (length << 40 | rank) - first
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(sequence + k // items), pa.array(offset + k % items * length)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PLACED.split(", ")])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = here.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")).hint("shuffle_hash")
    ranked = open_pieces.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("_first") + F.col("nth")).alias("rank"))
    whole = pieces.filter(F.col("length") == window).select("doc_id", "piece", "start", "length", "ids", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(ranked.mapInArrow(place, PLACED))
