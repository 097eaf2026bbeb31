"""Image references of documents: where their files are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.terminal import is_local


def joined_path(folder: Column, src: Column) -> Column:
    """A path below a folder, unless it starts at the root."""
    return F.when(src.startswith("/"), src).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), src))


def existing(paths: DataFrame, listing: DataFrame, path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """``paths`` with ``exists``, ``is_file`` and ``is_dir``, by a listing of what there is."""
    there = listing.select(F.col(path), F.col(is_dir).alias("_dir")).groupBy(path).agg(F.bool_or("_dir").alias("_dir"))
    joined = paths.join(there, path, "left")
    return joined.select(*paths.columns, F.col("_dir").isNotNull().alias("exists"), F.coalesce(~F.col("_dir"), F.lit(False)).alias("is_file"), F.coalesce("_dir", F.lit(False)).alias("is_dir"))


def located(refs: DataFrame, files: DataFrame, src: str = "src", folder: str = "dir", path: str = "path") -> DataFrame:
    """``refs`` with ``local`` and ``found``: a local image's path as it is, else below its document's folder, else null.

    Each file is found by equality, first of the path as it stands, then of the
    joined one.
    """
    here = files.select(F.col(path).alias("_here")).distinct()
    there = files.select(F.col(path).alias("_there")).distinct()
    d = refs.withColumn("local", is_local(F.col(src))).withColumn("_own", F.when(F.col("local"), F.col(src)))
    d = d.withColumn("_below", F.when(F.col("local"), joined_path(F.col(folder), F.col(src))))
    d = d.join(here, F.col("_own") == F.col("_here"), "left").join(there, F.col("_below") == F.col("_there"), "left")
    return d.select(*refs.columns, "local", F.coalesce("_here", "_there").alias("found"))
