"""Folders of delimited files, each with its own delimiter and header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.tables import detect_delimiter
from quire.shared import written

SCHEMA = "path string, place long, names array<string>, cells array<string>, error string"


def first_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, line): the first line of each file below a folder."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    starts = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value").filter("at = 0")
    return starts.withColumn("id", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "id").alias("line"))


def read_delimited(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, place, names, cells, error): the rows of all delimited files below a folder, numbered from 1 by file.

    The scan is planned in two steps: the first line of each file tells its delimiter and
    how many columns it has; then all files of one delimiter and width are one
    native read, with quotes and cells over several lines. A file with a row
    of another width is an error, and one row says so; so is one whose header can't
    be told. Empty cells are ''. The plan holds each file's path, as any scan of files does.
    """
    head = first_lines(spark, path, pattern).withColumn("sep", detect_delimiter(F.col("line")))
    # the header by the same rules as the rows: quotes may hold delimiters
    width = F.size(F.regexp_extract_all(F.concat("sep", F.col("line")), F.concat(F.lit("[\\"), F.col("sep"), F.lit(r']\s*+(?:"(?:[^"]|"")*+"[^\\'), F.col("sep"), F.lit(r"]*+|[^\\"), F.col("sep"), F.lit("]*+)")), F.lit(0)))
    groups = head.select("path", "sep", width.alias("width")).groupBy("sep", "width").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    none = spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, [_same_kind(spark, g["paths"], g["sep"], g["width"]) for g in groups], none)


def _same_kind(spark: SparkSession, paths: list[str], sep: str, width: int) -> DataFrame:
    columns = [f"c{k}" for k in range(width)]
    schema = ", ".join(f"{c} string" for c in columns) + ", _bad string"
    options = {"sep": sep, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "enforceSchema": True}
    d = spark.read.schema(schema).options(**options).csv(paths)
    cells = F.array(*[F.coalesce(c, F.lit("")) for c in columns])
    d = d.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"), (F.col("_bad").isNotNull()).alias("bad"), F.monotonically_increasing_id().alias("id"))
    # parsed once; a file with cells over several lines is read by one task, so that its ids are in a row
    d = written(d, "delimited")
    files = d.groupBy("path").agg(F.min("id").alias("first"), F.min_by("cells", "id").alias("names"), F.min(F.when(F.col("bad"), F.col("id"))).alias("bad_id"))
    fine = d.join(files.filter("bad_id is null"), "path").filter("id > first")
    rows = fine.select("path", (F.col("id") - F.col("first")).alias("place"), "names", "cells", F.lit(None).cast("string").alias("error"))
    said = F.concat(F.lit("row "), (F.col("bad_id") - F.col("first")).cast("string"), F.lit(" has not as many cells as the header"))
    none = F.lit(None)
    return rows.unionByName(files.filter("bad_id is not null").select("path", none.cast("long").alias("place"), "names", none.cast("array<string>").alias("cells"), said.alias("error")))
