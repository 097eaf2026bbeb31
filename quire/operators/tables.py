"""Markdown tables from rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import display_width_of, string_len

#: Delimiters that a header line may have; of equal counts the later wins.
DELIMITERS = (",", ";", "\t", "|")


def cell(column: str | Column, escape: bool = False) -> Column:
    """A value as a cell: text, empty where null. ``escape`` keeps bars and newlines inside the cell."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")) if escape else text


def row_line(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def header_lines(names: Sequence[str]) -> str:
    return f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n"


def markdown_table(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (), escape: bool = False) -> DataFrame:
    """(by..., md): the rows of each group as one table, in order.

    A table is one value; the rows of a group meet in one task.
    """
    line = row_line([cell(c, escape) for c in columns])
    rows = df.select(*by, F.struct(*order, line.alias("_line")).alias("_row"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["_line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(header_lines(columns)), body, F.lit("\n")).alias("md"))


def table_of(header: Column, rows: Column) -> Column:
    """A table of a header array and an array of row arrays, each as wide as it is."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"))
    return F.concat(line(header), F.lit("|"), F.repeat(F.lit("---|"), F.size(header)), F.lit("\n"), F.array_join(F.transform(rows, line), ""))


def detect_delimiter(line: Column) -> Column:
    """The delimiter that a line has most of; the last candidate where none or several lead."""
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    scored = F.array(*[F.struct(count(d).alias("n"), F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    return F.array_max(scored)["d"]


def column_widths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, width): the columns of a terminal that the widest line of each column's cells takes, its name included.

    Lines are trimmed. All cells are measured together, a row of the input at a time.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), cell(c).alias("text")) for c in columns])).alias("c"))
    lines = cells.select(F.col("c.name").alias("name"), F.explode(F.split("c.text", "\n")).alias("line"))
    widths = lines.groupBy("name").agg(F.max(string_len(F.trim("line"))).alias("width"))
    names = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(display_width_of(c)).alias("least")) for c in columns])))
    return names.join(widths, "name", "left").select("name", F.greatest("least", F.coalesce("width", F.lit(0))).alias("width"))


def row_heights(columns: Sequence[str]) -> Column:
    """The lines that a row takes: those of its cell with most, at least one."""
    ended = lambda c: F.regexp_replace(cell(c), r"\r?\n\z", "")
    return F.greatest(F.lit(1), *[F.size(F.split(ended(c), "\n")) for c in columns], F.lit(1))
