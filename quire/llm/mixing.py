"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, block_bits, small, text_of, written

#: Rows that a block of a distributed running sum is meant to hold.
BLOCK_ROWS = 4096


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], name: str) -> DataFrame:
    """The rows with column ``place``, from 0, and for each of ``sums`` what it adds up to in the rows before, in ``order``.

    Rows are dealt by ranges of the order and written; windows run inside the ranges, and what the ranges before add up to, a row for
    each of as many as shuffle partitions, comes through the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("_id", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    totals = rows.groupBy("_part").agg(F.count("*").alias("place"), *[F.sum(f"_{k}").alias(k) for k in sums]).collect()
    by_part = {r["_part"]: r for r in totals}
    before = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for k in ("place", *sums):
        upto = [0]
        for part in range(max(by_part, default=-1) + 1):
            upto.append(upto[-1] + ((by_part[part][k] or 0) if part in by_part else 0))
        inside = F.coalesce(F.sum(F.lit(1) if k == "place" else F.col(f"_{k}")).over(before), F.lit(0))
        out[k] = F.get(F.array(*map(F.lit, upto)), F.col("_part")) + inside
    return rows.withColumns(out).drop("_id", "_part", *[f"_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: int) -> DataFrame:
    """(key, source, source_size, weight, target): the budget shared by weight, no target over its cap.

    ``weights`` repeat over the sources in code point order, null last. Sorted
    by cap per weight, the sources up to some place take their cap, and all
    others share the rest of the budget by weight; running sums find the place.
    """
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = running(totals, [F.col("source").asc_nulls_last()], {}, "sources")
    placed = placed.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    placed = placed.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running(placed, ["ratio", "key"], {"taken": F.col("cap"), "passed": F.col("weight")}, "filled")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float((whole["size"] or 0) * budget_ratio)) - F.col("taken")) / (F.lit(float(whole["weight"] or 0)) - F.col("passed"))
    full = F.col("cap") <= level * F.col("weight")
    opened = filled.filter(~full).agg(F.min(F.struct("place", level.alias("level"))).alias("first")).first()["first"]
    target = F.when(full, F.col("cap")).otherwise(F.lit(opened["level"] if opened else None).cast("double") * F.col("weight"))
    return filled.select("key", "source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Chooses documents, whole and up to ``max_repeats`` times each, towards target sizes by source.

    Each source's documents are shuffled by a hash of seed, id and text. A document's
    virtual finish time is its source's size up to and with it, over the
    source's target; a second round continues where the first ended. All are
    put in order of finish time, and the order is cut where the whole budget is
    used. Returns a row per input row: ``doc_id``, ``source``, ``size`` (words
    unless ``size`` says otherwise), ``source_size``, ``target``, ``copies``,
    ``taken`` (= ``size`` x ``copies``) and ``text_fp``, a hash of the text (or
    the ``size`` given).

    A null text counts nothing and a null source is a source of its own, after
    all others. A document of size 0 is never taken more than its 0, and a
    source of size 0 has target 0. Rows of equal id and size tie in any order,
    which leaves the rows returned the same. An empty table gives an empty
    result. Reruns agree. Other columns aren't read.

    Running sums are taken in blocks of hash or finish time, of a few thousand
    rows each, and the sums of blocks in ranges of them, so that neither a source nor all blocks meet in one task.
    """
    # equal or null ids of a source are told apart by their texts, so that they fall in many blocks
    tie = F.xxhash64(text_of(text_col)) if size is None else size.cast("long")
    size = word_count(text_col) if size is None else size.cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), tie.alias("text_fp"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "key", "text_fp"))
    sizes = written(rows, "sizes")
    n = sizes.count()
    if not n:
        return sizes.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), "text_fp")
    bits = block_bits(n, BLOCK_ROWS)
    sizes = sizes.withColumn("block", F.shiftrightunsigned("h", 64 - bits))

    blocks = sizes.groupBy("key", "block").agg(F.sum("size").alias("block_size"))
    starts = running(blocks, ["key", "block"], {"start": F.col("block_size")}, "blocks").select("key", "block", "start")
    firsts = starts.groupBy("key").agg(F.min("start").alias("first_start"))
    targets = small(written(source_targets(sizes, weights, budget_ratio, max_repeats).join(firsts, "key"), "targets"), 200)
    within = Window.partitionBy("key", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("inside", F.sum("size").over(within)).join(starts, ["key", "block"])
    placed = placed.join(targets.drop("source"), "key").withColumn("end", F.col("start") - F.col("first_start") + F.col("inside"))
    finish = F.array(*[F.when(F.col("target") > 0, (F.col("end") + e * F.col("source_size")) / F.col("target")) for e in range(max_repeats)])
    placed = written(placed.select("doc_id", "source", "size", "source_size", "target", "key", "h", "text_fp", finish.alias("finish")), "placed")

    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    steps = 1 << bits
    each = placed.select("size", "key", "h", "doc_id", F.posexplode("finish").alias("epoch", "at")).filter("at is not null and size > 0")
    each = each.withColumn("bucket", F.floor(F.col("at") * steps))
    buckets = running(each.groupBy("bucket").agg(F.sum("size").alias("used")), ["bucket"], {"before": F.col("used")}, "buckets")
    buckets = buckets.withColumn("upto", F.col("before") + F.col("used"))
    # finish times are sums over a target, so that what ends within the budget may pass it by rounding
    edge = buckets.filter(F.col("upto") > budget * (1 + 1e-12)).orderBy("bucket").select("bucket", (F.col("upto") - F.col("used")).alias("start")).first()
    if edge is None:
        copies = F.aggregate("finish", F.lit(0), lambda n, x: n + F.when(x.isNotNull(), 1).otherwise(0))
    else:
        order = [F.col("at"), F.col("key"), F.col("h"), F.col("epoch")]
        last = (
            each.filter(F.col("bucket") == edge["bucket"])
            .withColumn("used", F.sum("size").over(Window.orderBy(*order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)) + edge["start"])
            .filter(F.col("used") <= budget * (1 + 1e-12))
            .orderBy(*[x.desc() for x in order])
            .select("at", "key", "h", "epoch")
            .first()
        )
        if last is None:
            cut = F.struct(F.lit(edge["bucket"] / steps), F.lit(""), F.lit(0).cast("long"), F.lit(0))
        else:
            cut = F.struct(F.lit(last["at"]), F.lit(last["key"]), F.lit(last["h"]).cast("long"), F.lit(last["epoch"]))
        copies = sum(F.when(F.struct(F.col("finish")[e], F.col("key"), F.col("h"), F.lit(e)) <= cut, 1).otherwise(0) for e in range(max_repeats))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    decided = placed.withColumn("copies", copies.cast("int"))
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_fp")
