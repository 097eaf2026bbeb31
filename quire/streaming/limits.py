"""Streams with limits: rows that come too soon after each other, and downloads that grow too large."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.shared import new_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _gathered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """A key's rows of a micro-batch, in order."""
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


class Throttle(StatefulProcessor):
    """Accepts a row if ``least`` seconds passed since the last accepted one of its key, which is the state.

    A key that is idle for ``idle`` seconds, at least as long, is forgotten by a
    timer in event time; that changes nothing, as its next row would be accepted anyway.
    """

    def __init__(self, ts: str, order: Sequence[str], least: float, idle: float):
        self.ts, self.order = ts, [ts, *order]
        self.least, self.idle_ms = round(least * 1e6), int(max(idle, least) * 1000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType().add("at", T.LongType()).add("timer", T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = _gathered(rows, self.order)
        held = self.last.get() if self.last.exists() else None
        last, timer = (held[0], held[1]) if held else (None, None)
        marks = []
        for at in own[self.ts].astype("datetime64[us]").astype("int64"):
            ok = last is None or at - last >= self.least
            last = at if ok else last
            marks.append(ok)
        if any(marks):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.idle_ms
            self.handle.registerTimer(timer)
            self.last.update((int(last), int(timer)))
        yield own.assign(accepted=marks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(rows: DataFrame, ts: str, by: Sequence[str], least: float = 0.05, order: Sequence[str] = (), late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """A stream's rows with column ``accepted``, as ``throttle`` gives it for a table.

    Rows of a micro-batch are taken in order of ``ts`` and ``order``. A row that
    comes after a later one was accepted isn't; one behind the watermark, which
    follows by ``late``, gives nothing. Null times can't be ordered and should be filtered before.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    grouped = rows.withWatermark(ts, late).groupBy(*by)
    return grouped.transformWithStateInPandas(Throttle(ts, order, least, idle), outputStructType=schema, outputMode="append", timeMode="eventTime")


class Cap(StatefulProcessor):
    """Gives a key's chunks while their running size, the state, stays within ``most``; then the key is closed."""

    def __init__(self, order: Sequence[str], size: str, most: int):
        self.order, self.size, self.most = list(order), size, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", T.StructType().add("size", T.LongType()).add("closed", T.BooleanType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, closed = self.held.get() if self.held.exists() else (0, False)
        if not closed:
            own = _gathered(rows, self.order)
            upto = own[self.size].fillna(0).astype("int64").cumsum() + size
            fit = (upto <= self.most).cummin()
            self.held.update((int(upto.iloc[-1]), not bool(fit.iloc[-1])))
            yield own.assign(upto=upto)[fit]

    def close(self) -> None:
        pass


def stream_capped(chunks: DataFrame, cap: int, by: str = "url", order: str = "ord", size: str = "size") -> DataFrame:
    """A stream's chunks with column ``upto``, each download up to the cap, as ``capped_chunks`` gives it for a table.

    Chunks of a download come in order; however they are cut into micro-batches,
    what follows the first that passes the cap is ignored. A null size counts nothing.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("upto", T.LongType())])
    return chunks.groupBy(by).transformWithStateInPandas(Cap([order], size, cap), outputStructType=schema, outputMode="append", timeMode="None")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source has, as a table; state and results are in the shared folder until the session ends."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
