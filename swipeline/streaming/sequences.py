"""Time gaps and chunk numbers on a stream of transactions, by state kept for each account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user long, card int, row_id long, time_full timestamp, time_delta_s long, seq_position long, chunk_id int, late boolean"


def stream_sequences(events: DataFrame, chunk: int = 315, delay: str = "1 hour", expire_s: int | None = None) -> DataFrame:
    """Adds time_delta_s, seq_position and chunk_id to a stream of (user, card, row_id, time_full) in order of time and row_id.

    The state of an account is its last time and its position. A transaction that comes after a later one of its account has been numbered
    is ``late``: it gets no position and changes no state. With all of an account's rows in one batch the result is that of the batch operators.

    Without ``expire_s`` states are kept for good, 16 bytes an account, as positions go on for good. With it the state of an account goes once
    the watermark (``delay`` behind the latest time) is so many seconds past its last time; its next transaction starts again at position 0.
    Spark then leaves out transactions older than the watermark altogether.
    """
    timeout = GroupStateTimeout.NoTimeout if expire_s is None else GroupStateTimeout.EventTimeTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, position = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["time_full", "row_id"])
        out = []
        for row_id, time in zip(rows["row_id"], rows["time_full"], strict=True):
            now = int(pd.Timestamp(time).timestamp())
            late = now < last
            gap = 0 if last < 0 else max(0, now - last)
            out.append((key[0], key[1], row_id, time, None if late else gap, None if late else position, None if late else position // chunk, late))
            if not late:
                last, position = now, position + 1
        state.update((last, position))
        if expire_s is not None:
            state.setTimeoutTimestamp(max((last + expire_s) * 1000, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"time_delta_s": "Int64", "seq_position": "Int64", "chunk_id": "Int32"})

    watched = events.withWatermark("time_full", delay)
    return watched.groupBy("user", "card").applyInPandasWithState(advance, OUT, "last long, position long", "append", timeout)
