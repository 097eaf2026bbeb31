"""Timed frames: the delay before each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.terminal import kitty_image
from quire.functions.text import base64

#: Seconds where a frame has no time of its own.
DEFAULT_DELAY = 0.033


def seconds(ts: Column) -> Column:
    """A timestamp as seconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def text_delays(frames: DataFrame, ts: str = "ts", by: Sequence[str] = ("video_id",), order: Sequence[str] = (), data: str | None = None) -> DataFrame:
    """Column ``delay``: seconds since the frame before if that is earlier, else the default. Frames without data are skipped first."""
    if data:
        frames = frames.filter(F.col(data).isNotNull() & (F.octet_length(data) > 0))
    before = F.lag(ts).over(Window.partitionBy(*by).orderBy(*(order or [ts])))
    return frames.withColumn("delay", F.when(F.col(ts) > before, F.col(ts) - before).otherwise(F.lit(DEFAULT_DELAY)))


def graphics_delays(frames: DataFrame, ts: str = "ts", by: Sequence[str] = ("video_id",), order: Sequence[str] = ()) -> DataFrame:
    """Column ``gap`` in ms, truncated: null for the first frame; the second counts from 0, not from the first."""
    w = Window.partitionBy(*by).orderBy(*(order or [ts]))
    place = F.row_number().over(w)
    before = F.when(place == 2, F.lit(0.0)).otherwise(F.lag(ts).over(w))
    return frames.withColumn("gap", F.when(place > 1, ((F.col(ts) - before) * 1000).cast("bigint")))


def animation_commands(
    frames: DataFrame, by: Sequence[str], order: Sequence[str], ts: str = "ts", data: str = "data", width: str = "width", height: str = "height", number: str = "id", tmux: bool = False,
) -> DataFrame:
    """(by..., place, step, command): what a terminal is sent to play frames of 24-bit pixels, in order of place and step.

    The first frame is transmitted as an image and its animation started; each frame after it is added with its gap in ms, where those
    that aren't positive are 0; after the last the animation runs on. A frame's commands are a row's work alone, but for its gap.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = graphics_delays(frames, ts, by, order).withColumn("place", F.row_number().over(w) - 1).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    start, end = ("\x1bPtmux;\x1b\x1b_G", "\x1b\x1b\\\x1b\\") if tmux else ("\x1b_G", "\x1b\\")
    size = text(",f=24,i=", F.col(number), ",s=", F.col(width), ",v=", F.col(height))
    gap = F.least(F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)), F.lit(2**32 - 1))
    pixels = base64(F.col(data))
    control = lambda state: text(f"{start}a=a,s={state},v=1,r=1,i=", F.col(number), f",z=100{end}")
    root = kitty_image(pixels, text("a=T", size), tmux=tmux)
    frame = kitty_image(pixels, text("a=f", size, ",c=", F.col("place") - 1, ",z=", gap), tmux=tmux, later="a=f")
    sent = F.when(F.col("place") == 0, F.array(root, control(2))).otherwise(F.array(frame))
    sent = F.concat(sent, F.when(F.col("_last"), F.array(control(3))).otherwise(F.array().cast("array<string>")))
    return d.select(*by, "place", F.posexplode(sent).alias("step", "command"))


def throttle(df: DataFrame, ts: str, by: Sequence[str], least: float = 0.05, order: Sequence[str] = ()) -> DataFrame:
    """Column ``accepted``: whether at least ``least`` seconds passed since the last accepted row of the group.

    That depends on what was accepted, so that each group is walked in order,
    in time-sorted batches that aren't gathered.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])
    n = len(by)

    def walk(batches):
        key = last = None
        for pdf in batches:
            marks = []
            for values, t in zip(pdf[list(by)].itertuples(index=False, name=None) if n else ((),) * len(pdf), pdf[ts], strict=True):
                if values != key:
                    key, last = values, None
                ok = last is None or t - last >= least
                last = t if ok else last
                marks.append(ok)
            yield pdf.assign(accepted=marks)

    return df.repartition(*by).sortWithinPartitions(*by, ts, *order).mapInPandas(walk, schema)


def carry_forward(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Column ``carried``: the last value that isn't null, up to and with the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(value, ignorenulls=True).over(w))
