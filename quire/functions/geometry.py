"""Sizes, places and colors as native column expressions.

Where the original computes in single precision, the casts do so at the same
steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x: Column) -> Column:
    return x.cast("float")


@dataclass(frozen=True)
class Screen:
    """A terminal's size in pixels and cells."""

    px_width: int = 1920
    px_height: int = 1080
    columns: int = 100
    rows: int = 20

    def scaled(self, scale: float) -> Screen:
        """Widths by a factor; heights stay."""
        return Screen(int(self.px_width * scale), self.px_height, int(self.columns * scale), self.rows)

    @staticmethod
    def of(measured: tuple[int, int], fallback: tuple[int, int], force: bool) -> tuple[int, int]:
        """A measured size, or the fallback if forced or where a side is 0."""
        return fallback if force or 0 in measured else measured


def fit(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    """struct<width, height>: the source's shape as large as fits the target."""
    source = f32(f32(sw) / f32(sh))
    wide = source > f32(f32(dw) / f32(dh))
    width = F.when(wide, dw.cast("int")).otherwise(F.round(f32(f32(dh) * source)).cast("int"))
    height = F.when(wide, F.round(f32(f32(dw) / source)).cast("int")).otherwise(dh.cast("int"))
    return F.struct(width.alias("width"), height.alias("height"))


def _number(dim: Column, suffix: str) -> Column:
    return F.regexp_extract(dim, rf"^\+?([0-9]+(?:\.[0-9]+)?){suffix}$", 1)


def dim_to_px(dim: Column, px: Column, cells: Column) -> Column:
    """A size in pixels: ``n``, ``npx``, ``nc`` cells or ``n%``; null where it is none of these."""
    whole = F.regexp_extract(dim, r"^\+?([0-9]+)(?:px)?$", 1)
    cell, percent = F.regexp_extract(dim, r"^\+?([0-9]+)c$", 1), _number(dim, "%")
    return (
        F.when(whole != "", whole.try_cast("int"))
        .when(cell != "", F.ceil(f32(f32(f32(px) / f32(cells)) * f32(cell))).cast("int"))
        .when(percent != "", F.ceil(f32(f32(px) * f32(f32(percent) / F.lit(100.0)))).cast("int"))
    )


def dim_to_cells(dim: Column, px: Column, cells: Column) -> Column:
    """A size in cells: ``n``, ``nc``, ``npx`` or ``n%``; null where it is none of these."""
    whole = F.regexp_extract(dim, r"^\+?([0-9]+)c?$", 1)
    pixel, percent = F.regexp_extract(dim, r"^\+?([0-9]+)px$", 1), _number(dim, "%")
    return (
        F.when(whole != "", whole.try_cast("int"))
        .when((pixel != "") & (px != 0) & (cells != 0), F.ceil(f32(f32(pixel) / f32(f32(px) / f32(cells)))).cast("int"))
        .when(percent != "", F.ceil(f32(f32(cells) * f32(f32(percent) / F.lit(100.0)))).cast("int"))
    )


def center_offset(width: Column, screen: Screen, cells: bool) -> Column:
    """The cells before an image in the middle; 0 if it is wider than the screen."""
    if cells:
        offset = f32(f32(F.lit(screen.columns) - width) / 2)
    else:
        offset = f32(f32(f32(F.lit(screen.px_width) - width) / 2) / f32(F.lit(screen.px_width / screen.columns)))
    return F.greatest(F.lit(0), F.round(offset).cast("int"))


def pad_offsets(width: Column, height: Column, size: Column) -> Column:
    """struct<x, y>: where an image of ``size`` stands in a box."""
    return F.struct(F.floor((width - size["width"]) / 2).cast("int").alias("x"), F.floor((height - size["height"]) / 2).cast("int").alias("y"))


def _scale(cw: Column, ch: Column, iw: Column, ih: Column, zoom: Column) -> Column:
    return f32(F.least(f32(f32(cw) / f32(iw)), f32(f32(ch) / f32(ih))) * f32(F.greatest(zoom, F.lit(1))))


def viewport(cw: Column, ch: Column, iw: Column, ih: Column, zoom: Column, pan_x: Column, pan_y: Column) -> Column:
    """struct<x, y, width, height>: what a zoomed and panned container shows of an image."""
    scale = _scale(cw, ch, iw, ih, zoom)

    def side(c: Column, i: Column, pan: Column) -> tuple[Column, Column]:
        size = F.least(F.round(f32(f32(c) / scale)).cast("int"), i)
        start = f32(f32(f32(i) / 2) + f32(pan)) - f32(f32(size) / 2)
        return F.least(F.greatest(f32(start), F.lit(0.0).cast("float")), f32(i - size)).cast("int"), size

    x, width = side(cw, iw, pan_x)
    y, height = side(ch, ih, pan_y)
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def pan_limits(cw: Column, ch: Column, iw: Column, ih: Column, zoom: Column) -> Column:
    """struct<x, y>: the greatest pan either way."""
    scale = _scale(cw, ch, iw, ih, zoom)
    side = lambda c, i: F.greatest(F.lit(0), ((i - F.least(F.round(f32(f32(c) / scale)).cast("int"), i)) / 2).cast("int"))
    return F.struct(side(cw, iw).alias("x"), side(ch, ih).alias("y"))


def clamp_pan(cw: Column, ch: Column, iw: Column, ih: Column, zoom: Column, pan_x: Column, pan_y: Column) -> Column:
    """struct<x, y>: a pan within the image; here the shown size is cut, not rounded."""
    scale = _scale(cw, ch, iw, ih, zoom)

    def side(c: Column, i: Column, pan: Column) -> Column:
        room = F.greatest(F.lit(0), ((i - f32(f32(c) / scale).cast("int")) / 2).cast("int"))
        return F.greatest(-room, F.least(room, pan))

    return F.struct(side(cw, iw, pan_x).alias("x"), side(ch, ih, pan_y).alias("y"))


def adjust_pan(pan: Column, delta: Column, limit: Column) -> Column:
    """A pan moved by ``delta``; a move beyond the limit is refused as a whole."""
    return F.when((delta != 0) & (F.abs(pan + delta) <= limit), pan + delta).otherwise(pan)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def visual_weight(r: Column, g: Column, b: Column, a: Column) -> Column:
    return luminance(r, g, b) * (a / 255.0)


def items_per_row(width: Column, narrow: int, wide: int, most: int) -> Column:
    """How many items of ``narrow`` to ``wide`` cells stand in a row."""
    return F.greatest(F.lit(1), F.least(F.ceil(width / wide), F.floor(width / narrow), F.lit(most).cast("bigint")).cast("int"))


def item_width(columns: Column, items: Column, padding: int) -> Column:
    return (F.round(f32(f32(f32(columns) / f32(items)) + F.lit(0.1).cast("float"))) - padding - 1).cast("int")


_PLACES = ("a", "b", "c", "d", "e", "f")


def matrix(*values: float) -> Column:
    return F.struct(*[F.lit(float(v)).cast("float").alias(k) for k, v in zip(_PLACES, values, strict=True)])


def multiply(m: Column, n: Column) -> Column:
    """The affine product of two matrices (a b c d e f)."""
    a = {k: m[k] for k in _PLACES}
    z = {k: n[k] for k in _PLACES}
    return F.struct(
        f32(a["a"] * z["a"] + a["b"] * z["c"]).alias("a"), f32(a["a"] * z["b"] + a["b"] * z["d"]).alias("b"),
        f32(a["c"] * z["a"] + a["d"] * z["c"]).alias("c"), f32(a["c"] * z["b"] + a["d"] * z["d"]).alias("d"),
        f32(a["e"] * z["a"] + a["f"] * z["c"] + z["e"]).alias("e"), f32(a["e"] * z["b"] + a["f"] * z["d"] + z["f"]).alias("f"),
    )


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    return F.struct(f32(m["a"] * x + m["c"] * y + m["e"]).alias("x"), f32(m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def distance(r: Column, g: Column, b: Column, r2: Column, g2: Column, b2: Column) -> Column:
    return (r - r2) * (r - r2) + (g - g2) * (g - g2) + (b - b2) * (b - b2)


def percent_of_255(c: Column) -> Column:
    return F.floor(c * 100 / 255).cast("int")


def sixel_char(bits: Column) -> Column:
    return F.char(bits.bitwiseAND(63) + 63)


def placeholder_colors(k: Column) -> Column:
    """struct<fore, back>: two of the 216 palette colors by number."""
    return F.struct((16 + k % 216).cast("int").alias("fore"), (16 + F.floor(k / 216) % 216).cast("int").alias("back"))


def frame_total(duration: Column, fps: Column) -> Column:
    """Frames of ``h:mm:ss.ff`` at a rate; null where the time isn't one."""
    p = r"(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = lambda k: F.regexp_extract(duration, p, k).try_cast("double")
    return F.round((part(1) * 3600 + part(2) * 60 + part(3)) * fps).cast("bigint")


def window(px: tuple[Column, Column], cells: tuple[Column, Column], fallback: Screen, force_px: Column, force_cells: Column, scale: Column) -> Column:
    """struct<px_width, px_height, columns, rows> of measured sizes: the fallback where forced or where a side is 0 or null, widths by a factor (null: 1)."""

    def pair(measured: tuple[Column, Column], width: int, height: int, force: Column) -> tuple[Column, Column]:
        off = F.coalesce(force, F.lit(False)) | (F.coalesce(measured[0], F.lit(0)) == 0) | (F.coalesce(measured[1], F.lit(0)) == 0)
        scaled = f32(F.when(off, width).otherwise(measured[0])) * f32(F.coalesce(scale, F.lit(1.0)))
        # sides are numbers of 16 bits
        return F.least(F.greatest(scaled.cast("int"), F.lit(0)), F.lit(65535)), F.when(off, height).otherwise(measured[1])

    (w, h), (columns, rows) = pair(px, fallback.px_width, fallback.px_height, force_px), pair(cells, fallback.columns, fallback.rows, force_cells)
    return F.struct(w.alias("px_width"), h.alias("px_height"), columns.alias("columns"), rows.alias("rows"))


def image_caps(width: Column, height: Column, screen: Screen, small: bool = False) -> Column:
    """struct<width, height>: the caps on an image in a text: 80 % of the width, 40 % of the height, else its own size; a ``small`` one is a pixel lower than a line."""
    line = max(0, math.ceil(screen.px_height / screen.rows) - 1)
    return F.struct(
        F.when(width > 0.8 * screen.px_width, F.lit("80%")).otherwise(F.concat(width.cast("string"), F.lit("px"))).alias("width"),
        F.lit(f"{line}px").alias("height") if small else F.when(height > 0.4 * screen.px_height, F.lit("40%")).otherwise(F.concat(height.cast("string"), F.lit("px"))).alias("height"),
    )


def gutter(count: Column) -> Column:
    """struct<width, left>: a gutter for numbers up to ``count``, two wider than the longest."""
    digits = F.length(count.cast("string"))
    return F.struct((digits + 2).alias("width"), F.lit(1).alias("left"))
