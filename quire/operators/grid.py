"""Drawn pages as character grids, and the boxes of their lines. DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let

#: Points of a page, and the most of them in a cell.
PAGE = (612.0, 792.0)
CELL = (4.0, 10.0)


def cell_size(columns: int | None = None, rows: int | None = None) -> tuple[float, float]:
    """Points in a cell of a screen, no more than ``CELL``."""
    wide = CELL[0] if columns is None else min(PAGE[0] / columns, CELL[0])
    high = CELL[1] if rows is None else min(PAGE[1] / rows, CELL[1])
    return wide, high


def page_rows(high: float) -> int:
    return int(-(-PAGE[1] // high)) + 1


def grid_text(texts: DataFrame, by: Sequence[str] = ("page",), order: str = "ord", columns: int | None = None, rows: int | None = None) -> DataFrame:
    """(by..., text): each page's texts (x, y, text) on its grid, later ones over earlier ones, blank edges cut.

    Cells are the nearest to a text's point, rows count from the page's top.
    Texts go on beyond the page's edge where the original cuts them. Characters meet as
    code points, whose state has a fixed width: a task holds the cells of its pages, however many texts are on them.
    """
    wide, high = cell_size(columns, rows)
    column = F.greatest(F.round(F.col("x") / wide), F.lit(0)).cast("int")
    row = F.lit(page_rows(high)) - F.round(F.col("y") / high).cast("int") - 1
    chars = texts.select(*by, F.col(order).alias("_ord"), row.alias("row"), column.alias("_at"), F.posexplode(F.split("text", "")).alias("_k", "char"))
    cells = chars.filter("char <> ''").groupBy(*by, "row", (F.col("_at") + F.col("_k")).alias("col")).agg(F.max_by(F.ascii("char"), "_ord").alias("code"))
    cells = cells.withColumn("char", F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32"))
    # each piece with the gap before it, so that no line is copied for each of its characters
    spaced = lambda a: F.transform(a, lambda c, i: F.concat(F.repeat(F.lit(" "), c["col"] - F.when(i > 0, F.get(a, i - 1)["col"]).otherwise(-1) - 1), c["char"]))
    line = F.array_join(let(F.sort_array(F.collect_list(F.struct("col", "char"))), spaced), "")
    lines = cells.groupBy(*by, "row").agg(F.rtrim(line).alias("line")).filter("line <> ''")
    parted = lambda a: F.transform(a, lambda x, i: F.concat(F.repeat(F.lit("\n"), F.when(i > 0, x["row"] - F.get(a, i - 1)["row"]).otherwise(0)), x["line"]))
    whole = F.array_join(let(F.sort_array(F.collect_list(F.struct("row", "line"))), parted), "")
    return lines.groupBy(*by).agg(whole.alias("text"))


def is_fake_line(width: Column, height: Column, least: float = 2.0) -> Column:
    """Whether a box is so thin one way, and only one, that it is a line."""
    return (width < least) != (height < least)


def boxes(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by..., x1, x2, y1, y2, fake_line): the box around the points of each path."""
    box = points.groupBy(*by).agg(F.min(x).alias("x1"), F.max(x).alias("x2"), F.min(y).alias("y1"), F.max(y).alias("y2"))
    return box.withColumn("fake_line", is_fake_line(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
