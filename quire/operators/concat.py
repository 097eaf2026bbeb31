"""Putting documents and images together in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.media import kind
from quire.functions.text import with_title


def concat_documents(df: DataFrame, text: str = "md", order: str = "ord", by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """(by..., text): the documents of each group in order, blank lines between them, trimmed at the ends.

    With ``name``, each stands under its title comment.
    """
    body = with_title(F.col(text), F.col(name)) if name else F.col(text)
    parts = F.sort_array(F.collect_list(F.struct(order, body.alias("_body"))))
    joined = F.array_join(F.transform(parts, lambda p: p["_body"]), "\n\n")
    return df.groupBy(*by).agg(F.regexp_replace(joined, r"^\s+|\s+\z", "").alias(text))


def assign_names(df: DataFrame, path: str = "path", name: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """The name that each document is shown under: none for a single one, else its own or its path."""
    several = F.count("*").over(Window.partitionBy(*by)) > 1
    return df.withColumn("title", F.when(several, F.coalesce(name, path)))


def kinds(df: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """(kind, first): the kinds of the inputs, and where each first stands; text for no input."""
    found = df.groupBy(kind(F.col(path)).alias("kind")).agg(F.min(order).alias("first"))
    none = found.sparkSession.range(1).select(F.lit("text").alias("kind"), F.lit(0).cast("long").alias("first"))
    empty = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("text").alias("_kind"))
    return found.unionByName(none.join(empty, none["kind"] == empty["_kind"], "left_semi"), allowMissingColumns=True)


def mixed_kinds(df: DataFrame, path: str = "path", interactive: bool = False) -> DataFrame:
    """(kinds, ok): whether inputs of these kinds may go together."""
    found = df.agg(F.sort_array(F.collect_set(kind(F.col(path)))).alias("kinds"))
    pair = F.col("kinds") == F.array(F.lit("image"), F.lit("text"))
    return found.withColumn("ok", (F.size("kinds") <= 1) | (F.lit(interactive) & pair))


def stack(df: DataFrame, by: Sequence[str], horizontal: bool = True, width: str = "width", height: str = "height") -> DataFrame:
    """(by..., width, height) of images next to each other or on top of each other."""
    sizes = (F.sum(width), F.max(height)) if horizontal else (F.max(width), F.sum(height))
    return df.groupBy(*by).agg(sizes[0].alias("width"), sizes[1].alias("height"))


def offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str = "width", padding: int = 0) -> DataFrame:
    """Each image's offset: the sizes and padding before it."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", padding + F.coalesce(F.sum(F.col(size) + padding).over(before), F.lit(0)))


def row_of_images(df: DataFrame, by: Sequence[str], order: Sequence[str], padding: int) -> DataFrame:
    """Each image's place (x, y) in its row, centred upright, with the row's size (row_width, row_height)."""
    row = Window.partitionBy(*by)
    out = offsets(df, by, order, "width", padding).withColumnRenamed("offset", "x")
    out = out.withColumn("row_height", F.max("height").over(row))
    out = out.withColumn("row_width", padding + F.sum("width").over(row) + padding * (F.count("*").over(row) - 1))
    return out.withColumn("y", F.floor((F.col("row_height") - F.col("height")) / 2).cast("int"))
