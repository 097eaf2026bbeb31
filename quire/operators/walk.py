"""Walks of folders: what ignore files and hidden names leave."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import let
from quire.operators.paths import ancestors

RULE = T.StructType().add("pattern", T.StringType()).add("keeps", T.BooleanType()).add("dirs", T.BooleanType())


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(pattern, whether it keeps, whether it is for directories alone) of a line of an ignore file; None where it says nothing.

    The pattern is a regular expression over paths relative to the file's
    folder. One with a slash before its end starts there, others match a name
    at any depth.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line
    line = line[1:] if line[:2] in (r"\#", r"\!") else line
    dirs = line.endswith("/")
    line = line.rstrip("/") if dirs else line
    if not line:
        return None
    rooted = "/" in line
    out, k = "", 0
    line = line.removeprefix("/")
    while k < len(line):
        rest = line[k:]
        if rest.startswith("**/") and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif rest == "**" and k and line[k - 1] == "/":
            out, k = out + ".+", k + 2
        elif rest[0] == "*":
            out, k = out + "[^/]*", k + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out, k = out + "[^/]", k + 1
        elif rest[0] == "[" and (end := line.find("]", k + 2)) > 0:
            inside = line[k + 1 : end]
            no = inside[0] in "!^"
            out, k = out + "(?!/)[" + ("^" if no else "") + inside[no:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&") + "]", end + 1
        else:
            k += rest[0] == "\\" and len(rest) > 1
            out, k = out + re.escape(line[k]), k + 1
    return ("^" if rooted else "^(?:.*/)?") + out + "$", keeps, dirs


@F.pandas_udf(RULE)
def _rule(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ignore_rule(x) or (None, None, None) for x in lines], columns=["pattern", "keeps", "dirs"])


def ignore_rules(files: DataFrame, folder: str = "dir", text: str = "text") -> DataFrame:
    """(dir, place, pattern, keeps, dirs) of ignore files, by the folder that they are in ("" is the root)."""
    lines = files.select(F.col(folder).alias("dir"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.select("dir", "place", _rule("line").alias("r")).select("dir", "place", "r.pattern", "r.keeps", "r.dirs").filter("pattern is not null")


def hidden(path: Column) -> Column:
    """Whether a name on the path starts with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]")


def walked(entries: DataFrame, rules: DataFrame | None = None, everything: bool = False, path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """The entries that a walk meets: none that is hidden or ignored, or below what is; with ``everything``, all.

    For each entry and each directory above it the rules of the folders on its
    way are met by equality of folder. The last rule of the deepest folder
    decides; a directory that is ignored takes all below it along.
    """
    if everything:
        return entries
    entries = entries.filter(~hidden(F.col(path)))
    if rules is None:
        return entries
    root = rules.filter("dir = ''").orderBy("place").collect()  # the lines of one file
    on_way = entries.select(F.col(path), F.explode(ancestors(F.col(path))).alias("target"), F.col(is_dir).alias("_dir"))
    on_way = on_way.withColumn("_dir", (F.col("target") != F.col(path)) | F.col("_dir"))
    folders = F.filter(ancestors(F.col("target")), lambda p: p != F.col("target"))
    every = on_way.select("target", "_dir").distinct()
    met = every.withColumn("dir", F.explode(folders)).join(rules.filter("dir <> ''"), "dir").withColumn("below", F.regexp_replace(F.expr("substring(target, length(dir) + 1)"), "^/", ""))
    met = met.filter((~F.col("dirs") | F.col("_dir")) & F.rlike("below", F.col("pattern")))
    met = met.select("target", "_dir", "dir", "place", "keeps")
    if root:
        # every path meets the root's rules, which are part of the expression, not one key of a join
        def of_root(below: Column) -> Column:
            said = [F.when((F.lit(not r["dirs"]) | F.col("_dir")) & below.rlike(r["pattern"]), F.struct(F.lit(r["place"]).alias("place"), F.lit(r["keeps"]).alias("keeps"))) for r in root]
            return F.filter(F.array(*said), lambda x: x.isNotNull())

        below = F.regexp_replace("target", "^/", "")
        hit = every.withColumn("last", F.array_max(let(below, of_root))).filter("last is not null")
        met = met.unionByName(hit.select("target", "_dir", F.lit("").alias("dir"), "last.place", "last.keeps"))
    last = met.groupBy("target", "_dir").agg(F.max_by("keeps", F.struct(F.length("dir"), F.col("place"))).alias("keeps"))
    gone = on_way.join(last.filter("not keeps").select("target", "_dir"), ["target", "_dir"], "left_semi").select(F.col(path)).distinct()
    return entries.join(gone, path, "left_anti")
