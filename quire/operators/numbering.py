"""Numbers over a whole table without a task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shared import written

#: Bits of a row's place within its partition in Spark's increasing ids.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n", start: int = 0, parts: int | None = None) -> DataFrame:
    """Column ``name``: the place of each row in ``order``, from ``start``.

    The rows are dealt by ranges of the order, sorted in each range and written
    once; a row's number is its place in its range and the counts of the ranges
    before, of which there are as many as shuffle partitions (or ``parts``). Rows
    that tie are numbered in any order, nulls come first, and an empty table
    stays empty.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn(f"_{name}", F.monotonically_increasing_id())
    rows = written(placed, "numbered")
    part, place = F.shiftright(f"_{name}", _PLACE_BITS).cast("int"), F.col(f"_{name}").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = {r["part"]: r["rows"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()}
    before, total = [], start
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offsets = F.array(*[F.lit(x).cast("long") for x in before or [start]])
    return rows.withColumn(name, F.get(offsets, part) + place).drop(f"_{name}")
