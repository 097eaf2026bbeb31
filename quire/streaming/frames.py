"""Delays of a stream of frames, with the last time as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.frames import DEFAULT_DELAY

SCHEMA = "video_id long, frame_id long, ts double, delay double"


def _delays(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "frame_id"], kind="stable")
    out = []
    for frame, ts in zip(rows["frame_id"], rows["ts"], strict=True):
        out.append((key[0], frame, ts, ts - last if last is not None and ts > last else DEFAULT_DELAY))
        last = ts
    state.update((last,))
    yield pd.DataFrame(out, columns=["video_id", "frame_id", "ts", "delay"])


def stream_delays(frames: DataFrame) -> DataFrame:
    """(video_id, frame_id, ts, delay) of a stream of (video_id, frame_id, ts seconds), in order of time within each batch.

    The state of a video is its last time alone.
    """
    d = frames.select(F.col("video_id").cast("long"), F.col("frame_id").cast("long"), F.col("ts").cast("double"))
    return d.groupBy("video_id").applyInPandasWithState(_delays, SCHEMA, "last double", "append", GroupStateTimeout.NoTimeout)


def capped_chunks(chunks: DataFrame, cap: int, by: str = "url", order: str = "ord", size: str = "size") -> DataFrame:
    """The chunks of each download up to which its running size stays within ``cap`` (a table, not a stream)."""
    from pyspark.sql import Window

    upto = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("upto", upto).filter(F.col("upto") <= cap)
