"""Corpus lines from a stream of transactions: each account's open line is state, a full one leaves, and a timer closes a quiet one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from swipeline.operators.steps import TimeDelta
from swipeline.operators.tokens import TokenPipeline
from swipeline.sources.io import require

#: Stands in a line where the token of a time gap goes, which only the account's state knows.
GAP = "\x00"
ROWS = "user long, card int, chunk_id int, late long, lines array<string>, gaps array<long>"
SECOND = 1_000_000


class OpenLines(StatefulProcessor):
    """State of an account: (last time, next position, rows of the open line, late rows not told of yet, timer), and the open line's rows.

    Only a line that leaves is read: rows go to the end of the list, and the numbers beside it say when it is full.
    """

    def __init__(self, chunk: int, quiet_s: int | None):
        self.chunk, self.quiet_s = chunk, quiet_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "last long, position long, held long, late long, timer long")
        self.open = handle.getListState("open", "line string, gap long")

    def line(self, key: tuple, position: int, late: int, rows: list[tuple]) -> pd.DataFrame:
        chunk_id = (position - 1) // self.chunk
        lines, gaps = [r[0] for r in rows], [int(r[1]) for r in rows]
        return pd.DataFrame({"user": [key[0]], "card": [key[1]], "chunk_id": [chunk_id], "late": [late], "lines": [lines], "gaps": [gaps]})

    def taken(self, held: int, new: list[tuple]) -> list[tuple]:
        """The rows of the open line and the new ones; the state is left without any."""
        if not held:
            return new
        rows = [*self.open.get(), *new]
        self.open.clear()
        return rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, position, held, late, timer = self.numbers.get() or (None, 0, 0, 0, 0)
        new = []
        for row in pd.concat(list(rows)).sort_values(["at", "row_id"]).itertuples(index=False):
            if last is not None and row.at < last:
                late += 1
                continue
            if self.quiet_s is not None and held + len(new) and row.at - last > self.quiet_s * SECOND:
                yield self.line(key, position, late, self.taken(held, new))
                position += -position % self.chunk
                held, late, new = 0, 0, []
            new.append((row.line, 0 if last is None else (row.at - last) // SECOND))
            last, position = row.at, position + 1
            if held + len(new) == self.chunk:
                yield self.line(key, position, late, self.taken(held, new))
                held, late, new = 0, 0, []
        if new:
            self.open.appendList(new)
            held += len(new)
        if self.quiet_s is not None:
            timer = self.timer(timer, (last // SECOND + self.quiet_s) * 1000 if held else 0, timerValues.getCurrentWatermarkInMs())
        self.numbers.update((last, position, held, late, timer))

    def timer(self, old: int, new: int, now: int) -> int:
        new = max(new, now + 1) if new else 0
        if old != new:
            if old:
                self.handle.deleteTimer(old)
            if new:
                self.handle.registerTimer(new)
        return new

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, position, held, late, _ = self.numbers.get()
        if held:
            yield self.line(key, position, late, self.taken(held, []))
            position += -position % self.chunk
        self.numbers.update((last, position, 0, 0, 0))


def stream_corpus(typed: DataFrame, pipeline: TokenPipeline, chunk: int = 315, delay: str = "1 hour", quiet_s: int | None = None) -> DataFrame:
    """(user, card, chunk_id, n_txn, late, text): a line for each ``chunk`` transactions of an account, as ``TokenPipeline.corpus`` makes them.

    ``typed`` is a stream as ``preprocess(..., gaps=False)`` gives it. An account's rows of a batch go on where its earlier ones ended, by time and row_id; a row before the
    account's last one is late: it is in no line, and the account's next line says how many there were. Spark leaves out rows behind the watermark, ``delay``
    before the latest time. With ``quiet_s`` a line ends short if the account's next row comes more than so many seconds later, and that row begins the next
    chunk; the short line leaves with that row, or by a timer once the watermark is so far, whichever is first, so how the stream is cut into batches does not show in the lines. Without
    it only full lines leave. The tokens of time gaps come from the state too. A restart from the checkpoint goes on as if nothing had been.

    An account costs some 40 bytes of state and its open line, kept in RocksDB: set spark.sql.streaming.stateStore.providerClass to its provider.
    """
    require(typed, ["user", "card", "row_id", "time_full"])
    gap = {s.name: s for s in pipeline.steps if isinstance(s, TimeDelta)}
    line = F.concat_ws(" ", *(F.lit(f"{GAP}{s.name}{GAP}") if s.name in gap else s.token() for s in pipeline.steps))
    time = F.col("time_full").cast("timestamp")
    rows = typed.select(F.col("user").cast("long").alias("user"), F.col("card").cast("int").alias("card"), "row_id", time.alias("time_full"), F.unix_micros(time).alias("at"), line.alias("line"))
    lines = rows.withWatermark("time_full", delay).groupBy("user", "card").transformWithStateInPandas(OpenLines(chunk, quiet_s), ROWS, "append", "eventTime")

    def filled(x, seconds):
        for name, step in gap.items():
            x = F.replace(x, F.lit(f"{GAP}{name}{GAP}"), step.token_of(seconds))
        return x

    body = F.array_join(F.zip_with("lines", "gaps", filled), " <sep> ")
    return lines.select("user", "card", "chunk_id", F.size("lines").alias("n_txn"), "late", F.concat(F.lit("<bos> "), body, F.lit(" <eos>")).alias("text"))
