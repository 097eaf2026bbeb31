"""Inputs of a run: which, in what order, and what a label stands for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import extension


def all_inputs(piped: DataFrame, given: DataFrame, order: str = "ord") -> DataFrame:
    """Piped inputs before those that were named, each in its order, numbered by struct ``place``."""
    numbered = lambda d, k: d.withColumn("place", F.struct(F.lit(k).alias("group"), F.col(order).cast("long").alias("ord")))
    return numbered(piped, 0).unionByName(numbered(given, 1))


def first_input(inputs: DataFrame, by: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """The first input of each group; an aggregate, so that no group is sorted."""
    columns = [c for c in inputs.columns if c not in by]
    first = inputs.groupBy(*by).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_first"))
    return first.select(*by, "_first.*")


def labelled(paths: Column, labels: Column) -> Column:
    """array<struct<label, path>> of two arrays, place by place; what has no partner goes."""
    pairs = F.arrays_zip(labels.alias("label"), paths.alias("path"))
    return F.filter(pairs, lambda p: p["label"].isNotNull() & p["path"].isNotNull())


def chosen_paths(trees: DataFrame, chosen: DataFrame, by: Sequence[str], paths: str = "paths", labels: str = "labels", label: str = "label") -> DataFrame:
    """(by..., label, path) of chosen labels; of equal labels of a tree the last path, and labels that it lacks go."""
    each = trees.select(*by, F.posexplode(labelled(F.col(paths), F.col(labels))).alias("_k", "_p"))
    index = each.groupBy(*by, F.col("_p.label").alias(label)).agg(F.max_by("_p.path", "_k").alias("path"))
    return chosen.select(*by, label).distinct().join(index, [*by, label])


def video_list(videos: DataFrame, by: Sequence[str] = (), order: str = "ord", path: str = "path") -> DataFrame:
    """(by..., list, ext): the lines that name a group's videos in order, and the extension of the first."""
    parts = F.sort_array(F.collect_list(F.struct(order, path)))
    lines = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("file '"), p[path], F.lit("'\n"))), "")
    return videos.groupBy(*by).agg(lines.alias("list"), F.coalesce(extension(F.min_by(path, order)), F.lit("")).alias("ext"))


def page_files(entries: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """(by..., pages): the page images among files, by name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    kept = entries.filter(F.regexp_extract(path, r"\.([^./]*)$", 1).isin("jpg", "jpeg"))
    parts = F.sort_array(F.collect_list(F.struct(name.alias("name"), F.col(path).alias("path"))))
    return kept.groupBy(*by).agg(F.transform(parts, lambda p: p["path"]).alias("pages"))
