"""Sliding-window rate limits: a hit is accepted if fewer than `limit` accepted ones are in the last `window` seconds.

Rejected hits are not recorded, so acceptance feeds back and no window frame can express it; the hits of one
key are walked in order. State is at most `limit` times per key, in the batch and in the streaming form.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limited(df: DataFrame, key: str, at: str, id_col: str, limit: int = 30, window: float = 600) -> DataFrame:
    """id, key, accepted of every hit. Partitions are sorted by key and time and walked once: a key's hits are streamed, never gathered."""
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "id")
    span = int(window * 1_000_000)

    def run(batches):
        current, recent = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != current:
                    current, recent = k, deque()
                while recent and t - recent[0] >= span:
                    recent.popleft()
                ok = len(recent) < limit
                if ok:
                    recent.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(out, pa.bool_())], names=["id", "key", "accepted"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kind['id']}, key {kind['key']}, accepted boolean")


def rate_limited_stream(stream: DataFrame, key: str, at: str, id_col: str, limit: int = 30, window: float = 600) -> DataFrame:
    """The same over a stream: the times of accepted hits are the state of a key, dropped when the window has passed."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = stream.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    span = int(window * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for f in [pd.concat(list(frames)).sort_values(["at", "id"])]:
            ok = []
            for t in f["at"].tolist():
                recent = [x for x in recent if t - x < span]
                ok.append(len(recent) < limit)
                if ok[-1]:
                    recent.append(t)
            yield pd.DataFrame({"id": f["id"].to_numpy(), "key": f["key"].to_numpy(), "accepted": ok})
        state.update((recent,))
        state.setTimeoutDuration(int(window * 1000))

    return rows.groupBy("key").applyInPandasWithState(step, f"id {kind['id']}, key {kind['key']}, accepted boolean", "recent array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)
