"""Pixel tables from raw raster files, to PNG bytes, and at other sizes. Pixels are rows (image, x, y, r, g, b, a)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import fit, pad_offsets
from quire.functions.text import let

CHANNELS = ("r", "g", "b", "a")

# --- reading

#: Bytes of pixel rows that go to a task at a time.
PIECE_BYTES = 4 << 20

_PNM = r"^P([56])(?:\s++|#[^\n]*+\n)++(\d++)(?:\s++|#[^\n]*+\n)++(\d++)(?:\s++|#[^\n]*+\n)++(\d++)\s"


def _number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes from byte ``at``."""
    raw = F.substring(data, at + 1, size)
    digits = F.hex(raw)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)])
    return F.conv(digits, 16, 10).cast("long")


def raster_layout(content: Column) -> Column:
    """The ``_layout`` of a raster's bytes, which are bound once: spelled out wherever a plan names it, it would be too much code."""
    return let(content, _layout)


def _layout(content: Column) -> Column:
    """struct<kind, width, height, channels, depth, start, flipped> of a raster's bytes; null for others.

    Known are binary PNM (P5 gray, P6 color; one or two bytes a sample), farbfeld, and uncompressed TGA (gray,
    24 and 32 bits). ``depth`` is the greatest sample value, ``start`` where rows of pixels begin; a ``flipped`` file has
    its lowest row first. A file that is shorter than its header says is none.
    """
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    part = lambda k: F.regexp_extract(head, _PNM, k)
    layout = lambda kind, width, height, channels, depth, start, flipped: F.struct(
        F.lit(kind).alias("kind"), width.cast("long").alias("width"), height.cast("long").alias("height"), channels.cast("int").alias("channels"),
        depth.cast("int").alias("depth"), start.cast("long").alias("start"), flipped.alias("flipped"),
    )
    no = F.lit(False)
    pnm = layout("pnm", part(2).try_cast("long"), part(3).try_cast("long"), F.when(part(1) == "6", 3).otherwise(1), part(4).try_cast("int"), F.length(part(0)), no)
    farbfeld = layout("farbfeld", _number(content, 8, 4), _number(content, 12, 4), F.lit(4), F.lit(65535), F.lit(16), no)
    bits, what = _number(content, 16, 1), _number(content, 2, 1)
    tga = layout("tga", _number(content, 12, 2, True), _number(content, 14, 2, True), (bits / 8), F.lit(255), 18 + _number(content, 0, 1), F.shiftright(_number(content, 17, 1).cast("int"), 5) % 2 == 0)
    plain = (_number(content, 1, 1) == 0) & (((what == 2) & bits.isin(24, 32)) | ((what == 3) & (bits == 8))) & (F.octet_length(content) > 18)
    found = F.when(head.rlike(_PNM), pnm).when(head.startswith("farbfeld"), farbfeld).when(plain, tga)
    size = found["height"] * found["width"] * found["channels"] * F.when(found["depth"] > 255, 2).otherwise(1)
    return F.when((found["depth"].between(1, 65535)) & (found["width"] > 0) & (found["start"] + size <= F.octet_length(content)), found)


def raster_pixels(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, x, y, r, g, b, a) of raster files, samples as 0 to 255; files of other kinds give nothing.

    Rows of pixels have one width, so that a file is cut into ranges of rows that are dealt to tasks on their own; a large
    file is read by many. Gray is all three colors; without alpha it is 255.
    """
    d = files.select(key, F.col(content).alias("_content"), raster_layout(F.col(content)).alias("_l")).filter("_l is not null")
    stride = F.col("_l.width") * F.col("_l.channels") * F.when(F.col("_l.depth") > 255, 2).otherwise(1)
    d = d.withColumn("_stride", stride).withColumn("_step", F.greatest(F.lit(1), F.floor(F.lit(PIECE_BYTES) / stride)).cast("long"))
    pieces = d.filter("_l.height > 0").withColumn("_top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l.height") - 1, F.col("_step"))))
    rows = F.least(F.col("_step"), F.col("_l.height") - F.col("_top"))
    raw = F.col("_content").substr((F.col("_l.start") + F.col("_top") * F.col("_stride") + 1).cast("int"), (rows * F.col("_stride")).cast("int"))
    pieces = pieces.select(key, "_top", "_l.kind", "_l.width", "_l.height", "_l.channels", "_l.depth", "_l.flipped", raw.alias("raw")).repartition(key, "_top")

    def run(batches):
        for batch in batches:
            for name, top, kind, width, height, channels, depth, flipped, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = np.frombuffer(data, ">u2" if depth > 255 else np.uint8).reshape(-1, width, channels).astype(np.int64)
                cells = ((cells * 510 + depth) // (2 * depth)).astype(np.int32)
                if kind == "tga":  # blue comes first
                    cells = cells[:, :, [2, 1, 0, 3][:channels]] if channels > 1 else cells
                colors = [cells[:, :, k] for k in range(3)] if channels > 1 else [cells[:, :, 0]] * 3
                alpha = cells[:, :, 3] if channels == 4 else np.full(cells.shape[:2], 255, np.int32)
                line = top + np.arange(len(cells))
                y = np.repeat(height - 1 - line if flipped else line, width).astype(np.int32)
                x = np.tile(np.arange(width, dtype=np.int32), len(cells))
                names = pa.array([name] * len(x), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, (x, y, *(c.ravel() for c in (*colors, alpha))))], [key, "x", "y", *CHANNELS])

    kind = files.schema[key].dataType.simpleString()
    return pieces.mapInArrow(run, f"`{key}` {kind}, x int, y int, r int, g int, b int, a int")


# --- writing

_MODULUS = 65521
_STORED = 65535


def _bytes(value: Column, size: int, little: bool = False) -> Column:
    """A number as hex digits of ``size`` bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]) if little else digits


def _chunk(kind: str, data: Column) -> Column:
    """A PNG chunk's hex digits: length, kind, data, and the checksum of both."""
    body = F.concat(F.lit(kind.encode().hex().upper()), data)
    return F.concat(_bytes(F.length(data) / 2, 4), body, _bytes(F.crc32(F.unhex(body)), 4))


def png(pixels: DataFrame, image: str = "img") -> DataFrame:
    """(image, png): pixels as PNG files, 8 bits and four channels, in stored blocks.

    A row of pixels is put together by itself, with its two sums; the file's Adler-32 follows from the sums
    of all rows, the checksums of chunks from their bytes. Pixels that are missing are
    transparent black. A file is one value, and so one task's work, as its format asks.
    """
    size = pixels.groupBy(image).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    cell = F.concat(*[_bytes(F.col(c), 1) for c in CHANNELS])
    held = pixels.groupBy(image, "y").agg(F.sort_array(F.collect_list(F.struct("x", cell.alias("cell"), *CHANNELS))).alias("cells"))
    every = size.select(image, "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).join(held, [image, "y"], "left")
    cells = F.coalesce("cells", F.array().cast(held.schema["cells"].dataType))
    # between what stands at places in order, as many empty cells as are missing
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["x"]).otherwise(-1)
    filled = F.array_join(F.transform(cells, lambda c, i: F.concat(F.repeat(F.lit("00000000"), c["x"] - before(i) - 1), c["cell"])), "")
    full = 4 * F.col("width") + 1
    line = F.rpad(F.concat(F.lit("00"), filled), (2 * full).cast("int"), "0")
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["r"] + c["g"] + c["b"] + c["a"])
    places = F.aggregate(
        cells, F.lit(0).cast("long"),
        lambda a, c: a + sum((4 * (F.col("width") - c["x"]) - k).cast("long") * c[name] for k, name in enumerate(CHANNELS)),
    )
    lines = every.select(image, "width", "height", "y", line.alias("line"), total.alias("total"), places.alias("places"))
    after = (F.col("height") - 1 - F.col("y")).cast("long") * (4 * F.col("width") + 1)
    sums = lines.groupBy(image, "width", "height").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda s: s["line"]), "").alias("raw"),
        ((F.lit(1) + F.sum("total")) % _MODULUS).alias("low"),
        ((F.first("height").cast("long") * (4 * F.first("width") + 1) + F.sum((F.col("places") + (F.col("total") % _MODULUS) * (after % _MODULUS)) % _MODULUS)) % _MODULUS).alias("high"),
    )
    n = F.length("raw") / 2

    def stored(at: Column) -> Column:
        piece = F.substring(F.col("raw"), (2 * at + 1).cast("int"), F.lit(2 * _STORED))
        length = F.least(F.lit(_STORED), n - at)
        return F.concat(_bytes(F.when(at + _STORED >= n, 1).otherwise(0), 1), _bytes(length, 2, True), _bytes(F.lit(_STORED) - length, 2, True), piece)

    blocks = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")), F.lit(_STORED).cast("long")), stored), "")
    header = F.concat(_bytes(F.col("width"), 4), _bytes(F.col("height"), 4), F.lit("0806000000"))
    data = F.concat(F.lit("7801"), blocks, _bytes(F.col("high"), 2), _bytes(F.col("low"), 2))
    parts = sums.select(image, _chunk("IHDR", header).alias("header"), _chunk("IDAT", data).alias("data"))
    return parts.select(image, F.unhex(F.concat(F.lit("89504E470D0A1A0A"), "header", "data", _chunk("IEND", F.lit("")))).alias("png"))


# --- resampling

#: Lobes of the filter.
LOBES = 3


def filter_weights(sizes: DataFrame) -> DataFrame:
    """(n_in, n_out, src, out, weight): what each place of a side gives to each place of its new length, by Lanczos' filter.

    The filter is as wide as its lobes, or wider by the factor that a side shrinks by; the weights of a
    place add up to 1. A row per pair of places that meet, for each distinct pair of lengths.
    """
    scale = F.col("n_in") / F.col("n_out")
    wide = F.greatest(scale, F.lit(1.0))
    center = (F.col("out") + 0.5) * scale
    first = F.greatest(F.floor(center - LOBES * wide), F.lit(0))
    last = F.least(F.ceil(center + LOBES * wide), F.col("n_in")) - 1

    def lobe(src: Column) -> Column:
        t = (src + 0.5 - center) / wide
        wave = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))
        return F.when(F.abs(t) < LOBES, wave(t) * wave(t / LOBES)).otherwise(0.0)

    d = sizes.select(F.col("n_in").cast("int"), F.col("n_out").cast("int")).distinct().withColumn("out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)))
    d = d.withColumn("met", F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda s: F.struct(s.alias("src"), lobe(s).alias("w"))))
    total = F.aggregate("met", F.lit(0.0), lambda a, m: a + m["w"])
    d = d.withColumn("total", total).select("n_in", "n_out", "out", "total", F.inline("met"))
    return d.select("n_in", "n_out", "src", "out", (F.col("w") / F.col("total")).alias("weight"))


def resample(pixels: DataFrame, targets: DataFrame, image: str = "img", pad: bool = False) -> DataFrame:
    """Images as large as fits their target, in their own shape: (image, x, y, r, g, b, a).

    ``targets`` has (image, width, height). Colors weigh by their alpha. The two sides are
    filtered one after the other, each by a join of pixels with the weights of their
    place and a sum; values are rounded at the end. With ``pad`` the image stands in the
    middle of its target and transparent pixels surround it. Images without a target are left out.
    """
    own = pixels.groupBy(image).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    sizes = own.join(targets.select(image, F.col("width").cast("int").alias("box_w"), F.col("height").cast("int").alias("box_h")), image)
    sizes = sizes.withColumn("fit", fit(F.col("w"), F.col("h"), F.col("box_w"), F.col("box_h")))
    sizes = sizes.select(image, "w", "h", "box_w", "box_h", F.greatest("fit.width", F.lit(1)).alias("new_w"), F.greatest("fit.height", F.lit(1)).alias("new_h"))
    values = pixels.select(image, "x", "y", *[(F.col(c) * F.col("a") / 255.0).alias(c) for c in "rgb"], F.col("a").cast("double").alias("a"))

    def one_side(d: DataFrame, place: str, other: str, old: str, new: str) -> DataFrame:
        weights = filter_weights(sizes.select(F.col(old).alias("n_in"), F.col(new).alias("n_out")))
        met = d.join(sizes.select(image, F.col(old).alias("n_in"), F.col(new).alias("n_out")), image).withColumnRenamed(place, "src").join(weights, ["n_in", "n_out", "src"])
        return met.groupBy(image, other, F.col("out").alias(place)).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in CHANNELS])

    done = one_side(one_side(values, "x", "y", "w", "new_w"), "y", "x", "h", "new_h")
    whole = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 6) + 0.5))).cast("int")
    colors = [F.when(whole(F.col("a")) == 0, 0).otherwise(whole(F.col(c) * 255 / F.col("a"))).alias(c) for c in "rgb"]
    done = done.select(image, "x", "y", *colors, whole(F.col("a")).alias("a"))
    if not pad:
        return done
    at = pad_offsets(F.col("box_w"), F.col("box_h"), F.struct(F.col("new_w").alias("width"), F.col("new_h").alias("height")))
    moved = done.join(sizes.select(image, at.alias("at")), image).select(image, (F.col("x") + F.col("at.x")).alias("x"), (F.col("y") + F.col("at.y")).alias("y"), *CHANNELS)
    box = sizes.select(image, "box_w", F.explode(F.sequence(F.lit(0), F.col("box_h") - 1)).alias("y")).select(image, "y", F.explode(F.sequence(F.lit(0), F.col("box_w") - 1)).alias("x"))
    return box.join(moved, [image, "x", "y"], "left").fillna(0, list(CHANNELS)).select(image, "x", "y", *CHANNELS)
