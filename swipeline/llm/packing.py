"""Sum-of-squares online packing of tokenized documents into windows of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipeline.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online packing of one task's documents.

    ``open_at[h]`` lists the partly filled windows with h ids; ``levels[h]`` is how many they are. An item of s ids
    goes to the level h (0: a new window) that leaves the least sum of squared levels: h loses a window, h + s gains one
    unless it is full. Whole windows are cut off a long document first. Pieces of partly filled windows wait in memory: more
    than ``most_open`` windows, or the end of the task, dissolve the emptiest into the gaps of the fullest; as
    pieces may be cut anywhere no gap is left. Memory is most_open times window ids at most.
    """

    def __init__(self, window: int, first_id: int, most_open: int = 1024):
        self.window, self.next_id, self.most_open = window, first_id, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open_at: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level(self, size: int) -> int:
        used = np.flatnonzero(self.levels[1 : self.window - size + 1]) + 1
        change = -2 * self.levels[used] + 1
        up = used + size
        change += np.where(up < self.window, 2 * self.levels[up] + 1, 0)
        best = int(np.argmin(change)) if len(used) else -1
        new = 2 * int(self.levels[size]) + 1
        return int(used[best]) if best >= 0 and change[best] <= new else 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.close([(doc_id, at, ids[at : at + self.window], n)])
            at += self.window
        if n > at:
            self.place([(doc_id, at, ids[at:], n)], n - at)

    def place(self, pieces: list, size: int) -> None:
        h = self.level(size)
        if h:
            pieces = self.open_at[h].pop() + pieces
            self.levels[h] -= 1
            self.n_open -= 1
        self.keep(pieces, h + size)
        if self.n_open > self.most_open:
            self.dissolve(self.most_open // 2)

    def keep(self, pieces: list, fill: int) -> None:
        if fill == self.window:
            self.close(pieces)
        else:
            self.open_at.setdefault(fill, []).append(pieces)
            self.levels[fill] += 1
            self.n_open += 1

    def dissolve(self, left: int) -> None:
        """Fills the fullest windows with pieces of the emptiest, cut to fit, until ``left`` are open."""
        stack = [(h, p) for h in sorted(self.open_at) for p in self.open_at[h]]
        self.open_at, self.n_open = {}, 0
        self.levels[:] = 0
        low, high, spare = 0, len(stack) - 1, []
        while high >= low and high - low + 1 + bool(spare) > left:
            fill, pieces = stack[high]
            high -= 1
            while fill < self.window and (spare or low <= high):
                if not spare:
                    spare = stack[low][1][::-1]
                    low += 1
                doc_id, start, ids, n = spare.pop()
                cut = min(len(ids), self.window - fill)
                pieces.append((doc_id, start, ids[:cut], n))
                fill += cut
                if cut < len(ids):
                    spare.append((doc_id, start + cut, ids[cut:], n))
            self.keep(pieces, fill)
        for fill, pieces in stack[low : high + 1]:
            self.keep(pieces, fill)
        if spare:
            self.keep(spare[::-1], sum(len(x[2]) for x in spare))

    def finish(self) -> None:
        """All that is open, as full windows and one rest, which is cut into sequences of powers of two: no padding."""
        self.dissolve(0)
        for at in list(self.open_at):
            for pieces in self.open_at.pop(at):
                left = list(pieces[::-1])
                for size in (1 << k for k in range(at.bit_length() - 1, -1, -1) if at >> k & 1):
                    out, fill = [], 0
                    while fill < size:
                        doc_id, start, ids, n = left.pop()
                        cut = min(len(ids), size - fill)
                        out.append((doc_id, start, ids[:cut], n))
                        fill += cut
                        if cut < len(ids):
                            left.append((doc_id, start + cut, ids[cut:], n))
                    self.close(out)
        self.levels[:] = 0
        self.n_open = 0


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 2048, end_id: int = 1, most_open: int = 1024) -> DataFrame:
    """Pieces of all ``docs`` packed into sequences of at most ``window`` ids, one row a piece.

    A document's ids are those of its text (null: none) in the byte-level ``vocabulary`` and then ``end_id``. Each id
    is in exactly one piece: ``start`` is where it begins in its document, ``ids`` its ids as little-endian
    unsigned 32-bit numbers, ``offset`` its place in its sequence. Every task packs the documents it
    reads, online and with no shuffle, and numbers its sequences in a range of its own; its last rest is cut into
    sequences whose lengths are powers of two. A null doc_id, repeated rows and empty texts are documents like others, and a
    text of any length is cut into whole windows; columns of other names play no part; an empty table gives no rows.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 40, most_open)

        def rows() -> pa.RecordBatch:
            out, packer.rows = packer.rows, []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, np.array([*encode(text.as_py() or ""), end_id], "<u4"))
                if len(packer.rows) >= 2000:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
