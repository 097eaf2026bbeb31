"""Pixel tables: half blocks, palettes, bands and runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import distance, percent_of_255, sixel_char, visual_weight

#: Weights that a pixel needs to be drawn, in pairs and alone.
VISIBLE, VISIBLE_ALONE = 25, 35


def nearest(df: DataFrame, palette: Sequence[tuple[int, int, int]], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Each row's closest palette entry, ``idx`` and ``dist``: squared distance, of equal ones the first.

    The palette is a literal, at most 256 colors, and no row meets another.
    """
    if len(palette) > 256:
        raise ValueError("a palette has at most 256 colors")
    entries = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(x).alias("r"), F.lit(y).alias("g"), F.lit(z).alias("b")) for k, (x, y, z) in enumerate(palette)])
    scored = F.transform(entries, lambda p: F.struct(distance(F.col(r), F.col(g), F.col(b), p["r"], p["g"], p["b"]).alias("dist"), p["idx"].alias("idx")))
    best = F.array_min(scored)
    return df.withColumn("_best", best).select(*df.columns, F.col("_best.idx").alias("idx"), F.col("_best.dist").alias("dist"))


#: Centers that a row is compared with at once.
CENTER_BLOCK = 256


def nearest_vector(df: DataFrame, centers: DataFrame, vector: str = "embedding", center: str = "center", key: str = "idx") -> DataFrame:
    """Each row's closest center, of equal ones the least key, with the squared distance ``dist``.

    Centers are gathered in blocks of ``CENTER_BLOCK`` at most, dealt by a hash
    of their key. Of one block a row finds its best at once; where there are
    several, rows meet each block by its number and a salt, and the best of their bests
    stays. No center is held but with its block.
    """
    blocks = max(1, -(-centers.count() // CENTER_BLOCK))
    dealt = centers.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), key, center)
    gathered = dealt.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct(key, center))).alias("_centers"))
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.transform("_centers", lambda c: F.struct(square(c[center]).alias("dist"), c[key].alias(key))))
    if blocks == 1:
        met = df.withColumn("_block", F.lit(0)).join(F.broadcast(gathered), "_block").withColumn("_best", best)
    else:
        # a block's rows are shared by many tasks, each of which gets the block's centers
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks + 1
        rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod("_row", F.lit(salts)).cast("int"))
        rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt_out = gathered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        scored = rows.join(dealt_out, ["_block", "_salt"]).select("_row", F.struct(*df.columns).alias("_all"), best.alias("_best"))
        met = scored.groupBy("_row").agg(F.first("_all").alias("_all"), F.min("_best").alias("_best")).select("_all.*", "_best")
    return met.select(*df.columns, F.col(f"_best.{key}").alias(key), F.col("_best.dist").alias("dist"))


def palette_of(pixels: DataFrame, colors: int = 256, bits: int = 5) -> list[tuple[int, int, int]]:
    """A palette for pixels (r, g, b): median cut over the counts of colors in steps of 8.

    Pixels are counted where they are; of the at most 32768 counts, whatever
    the number of pixels, the box with the widest side is halved at its median
    until there are ``colors``. A box's color is the mean of its pixels, rounded.
    """
    step = 8 - bits
    cell = [F.shiftright(F.col(c).cast("int"), step).alias(f"_{c}") for c in "rgb"]
    counts = pixels.groupBy(*cell).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"])
    rows = sorted((r["_r"], r["_g"], r["_b"], r["n"], r["r"], r["g"], r["b"]) for r in counts.collect())
    boxes = [rows] if rows else []

    def spread(box: list) -> tuple[int, int]:
        return max((max(x[k] for x in box) - min(x[k] for x in box), -k) for k in range(3))

    while len(boxes) < colors:
        side, at = max(((spread(box), -i) for i, box in enumerate(boxes)), default=((0, 0), 0))
        if side[0] == 0:
            break
        box = sorted(boxes.pop(-at), key=lambda x: x[-side[1]])
        half, total, cut = sum(x[3] for x in box) / 2, 0, 1
        for cut, x in enumerate(box[:-1], 1):  # noqa: B007
            total += x[3]
            if total >= half:
                break
        boxes += [box[:cut], box[cut:]]
    mean = lambda box, k: round(sum(x[k] for x in box) / sum(x[3] for x in box))
    return sorted((mean(box, 4), mean(box, 5), mean(box, 6)) for box in boxes)


def half_blocks(pixels: DataFrame, image: str = "img") -> DataFrame:
    """(image, line, text): two pixel rows in one line of half blocks with 24-bit colors.

    A pair shows both halves, one or none by visual weight; a last odd row
    stands alone and needs more weight and an alpha.
    """
    p = pixels.withColumn("line", F.floor(F.col("y") / 2).cast("int")).withColumn("half", F.col("y") % 2)
    side = lambda h: F.first(F.when(F.col("half") == h, F.struct("r", "g", "b", "a")), ignorenulls=True)
    p = p.groupBy(image, "line", "x").agg(side(0).alias("top"), side(1).alias("low"))
    weight = lambda c: visual_weight(F.col(f"{c}.r"), F.col(f"{c}.g"), F.col(f"{c}.b"), F.col(f"{c}.a"))
    color = lambda c, k: F.concat(F.lit(f"\x1b[{k};2;"), F.concat_ws(";", f"{c}.r", f"{c}.g", f"{c}.b"), F.lit("m"))
    top, low = weight("top") > VISIBLE, weight("low") > VISIBLE
    alone = (weight("top") >= VISIBLE_ALONE) & (F.col("top.a") != 0)
    reset = F.lit("\x1b[0m")
    text = (
        F.when(F.col("low").isNull(), F.when(alone, F.concat(color("top", 38), F.lit("▀"), reset)).otherwise(" "))
        .when(top & low, F.concat(color("top", 38), color("low", 48), F.lit("▀"), reset))
        .when(top, F.concat(color("top", 38), F.lit("▀"), reset))
        .when(low, F.concat(color("low", 38), F.lit("▄"), reset))
        .otherwise(" ")
    )
    cells = F.sort_array(F.collect_list(F.struct("x", text.alias("cell"))))
    return p.groupBy(image, "line").agg(F.array_join(F.transform(cells, lambda c: c["cell"]), "").alias("text"))


def bands(pixels: DataFrame, by: Sequence[str] = ("img",), color: str = "idx") -> DataFrame:
    """(by..., band, color, x, bits): per band of six rows and color, the rows that have it as bits."""
    bit = F.call_function("shiftleft", F.lit(1), (F.col("y") % 6).cast("int"))
    return pixels.groupBy(*by, F.floor(F.col("y") / 6).cast("int").alias("band"), F.col(color).alias("color"), "x").agg(F.bit_or(bit).alias("bits"))


def runs(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., run, value, n): runs of equal values in order, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.select(*by, *order, value, starts.alias("_start"))
    d = d.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def run_text(char: Column, n: Column) -> Column:
    """A run as sixel data: up to three characters as they are, longer ones counted."""
    return F.when(n > 3, F.concat(F.lit("!"), n.cast("string"), char)).otherwise(F.repeat(char, n.cast("int")))


def sixel(pixels: DataFrame, palette: Sequence[tuple[int, int, int]], image: str = "img") -> DataFrame:
    """(image, data): images in sixel, by nearest palette colors, bands and runs."""
    size = pixels.groupBy(image).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    d = bands(nearest(pixels, palette), (image,), "idx")
    used = d.select(image, "band", "color").distinct().join(size, image)
    full = used.select(image, "band", "color", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    full = full.join(d, [image, "band", "color", "x"], "left").fillna(0, ["bits"])
    r = runs(full, "bits", ["x"], [image, "band", "color"])
    pieces = F.sort_array(F.collect_list(F.struct("run", run_text(sixel_char(F.col("bits")), F.col("n")).alias("t"))))
    lines = r.groupBy(image, "band", "color").agg(F.concat(F.lit("#"), F.col("color").cast("string"), F.array_join(F.transform(pieces, lambda p: p["t"]), "")).alias("line"))
    per_band = lines.groupBy(image, "band").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("color", "line"))), lambda c: c["line"]), "$").alias("text"))
    body = per_band.groupBy(image).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "text"))), lambda c: c["text"]), "-").alias("body"))
    colors = "".join(f"#{k};2;{x * 100 // 255};{y * 100 // 255};{z * 100 // 255}" for k, (x, y, z) in enumerate(palette))
    head = F.concat(F.lit('\x1bPq"1;1;'), F.col("width").cast("string"), F.lit(";"), F.col("height").cast("string"), F.lit(colors))
    return size.join(body, image).select(image, F.concat(head, F.col("body"), F.lit("\x1b\\")).alias("data"))


def palette_percent(r: Column, g: Column, b: Column) -> Column:
    return F.concat_ws(";", percent_of_255(r).cast("string"), percent_of_255(g).cast("string"), percent_of_255(b).cast("string"))


def image_pixels(images: DataFrame, key: str = "img") -> DataFrame:
    """(key, x, y, r, g, b, a) of rows with an image struct as Spark's image source reads them: BGR(A), row by row.

    An image's bytes are cut once; its pixels come a few rows at a time.
    """
    kind = images.schema[key].dataType

    def run(batches):
        for batch in batches:
            for name, w, h, channels, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                cells = np.frombuffer(data, np.uint8)[: w * h * channels].reshape(h, w, channels)
                blue, green, red = (cells[:, :, min(k, channels - 1)] for k in range(3)) if channels > 1 else [cells[:, :, 0]] * 3
                alpha = cells[:, :, 3] if channels == 4 else np.full((h, w), 255, np.uint8)
                step = max(1, 100_000 // max(1, w))
                for top in range(0, h, step):
                    part = slice(top, top + step)
                    n = red[part].size
                    place = np.arange(n)
                    planes = [x[part].ravel().astype(np.int32) for x in (red, green, blue, alpha)]
                    names = pa.array([name] * n, batch.schema.field(0).type)
                    columns = [(place % w).astype(np.int32), (top + place // w).astype(np.int32), *planes]
                    yield pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], [key, "x", "y", "r", "g", "b", "a"])

    d = images.select(key, "image.width", "image.height", "image.nChannels", "image.data").filter("data is not null")
    return d.mapInArrow(run, f"`{key}` {kind.simpleString()}, x int, y int, r int, g int, b int, a int")
