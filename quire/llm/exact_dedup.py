"""Exact dedup: counting quotient filters, then byte verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WS_RUN, block_bits, free_names, named_columns, small, text_of, written
from quire.llm.quotient import CountingQuotientFilter

#: Quotient bits below a segment: a run then holds a few remainders.
RUN_BITS = 12
#: A partition's filter is emitted whenever it holds this many fingerprints.
FILTER_ROWS = 1 << 19
#: Fingerprints that a segment is meant to hold.
SEGMENT_ROWS = 1 << 16


def normalised(column: str):
    """The text with every run of white space as one space."""
    return F.regexp_replace(text_of(column), WS_RUN, " ")


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the 64-bit fingerprints in column ``fp`` that occur more than once.

    Each partition builds filters; segments of them meet by quotient and are
    merged. A fingerprint counts once per partition on its way, however often it
    occurs there.
    """
    bits = block_bits(rows, SEGMENT_ROWS)
    quotient_bits = bits + RUN_BITS

    def build(batches):
        held: list[np.ndarray] = []

        def emit():
            built = CountingQuotientFilter.build(np.concatenate(held), quotient_bits)
            parts = list(built.segments(bits))
            held.clear()
            return pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([x[0] for x in parts], pa.int32()),
                    "quotients": pa.array([x[1].astype("<u2").tobytes() for x in parts], pa.binary()),
                    "remainders": pa.array([x[2].astype("<u8").tobytes() for x in parts], pa.binary()),
                    "counts": pa.array([x[3].astype("<i8").tobytes() for x in parts], pa.binary()),
                }
            )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield emit()
        if sum(map(len, held)):
            yield emit()

    def merge(segment: pa.Table) -> pa.Table:
        number = np.uint64(segment.column("segment")[0].as_py())
        filters = []
        for quotients, remainders, counts in zip(*(segment.column(c).to_pylist() for c in ("quotients", "remainders", "counts")), strict=True):
            # here the quotient is RUN_BITS wide, and the remainder moves up to fill 64 bits with it
            runs = np.frombuffer(quotients, "<u2").astype(np.uint64)
            filters.append(CountingQuotientFilter(RUN_BITS, runs, np.frombuffer(remainders, "<u8") << np.uint64(bits), np.frombuffer(counts, "<i8")))
        merged = filters[0].merge(*filters[1:])
        again = merged.counts > 1
        prints = (merged.fingerprints()[again] >> np.uint64(bits)) | (number << np.uint64(64 - bits))
        return pa.table({"fp": pa.array(prints.view(np.int64), pa.int64()), "n": pa.array(merged.counts[again], pa.int64())})

    parts = prints.select("fp").mapInArrow(build, "segment int, quotients binary, remainders binary, counts binary")
    return parts.groupBy("segment").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose texts are equal up to runs of white space.

    Returns a row per input row: ``doc_id``, ``keep_id`` (the smallest id among
    equal texts), ``group_size``, ``kept`` and ``text_sha256``. A null text is
    an empty one; empty texts are equal to each other. Null ids come after all
    others; a group of null ids has a null ``keep_id``. Of repeated rows (equal
    id and text) exactly one is kept. An empty table gives an empty result, and
    other columns of the input, whatever their names, aren't read.

    Texts move only where their fingerprint occurs more than once, and of equal
    texts one per task does.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    digest = written(
        texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")).withColumn("rid", F.monotonically_increasing_id()),
        "digest",
    )
    repeated = small(written(repeated_fingerprints(digest, digest.count()), "repeated"), 40)

    verified = (
        texts.join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.count("*").alias("n"))
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "n")
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .filter("group_size > 1")
        .filter(F.when(F.col("texts") == 1, True).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("boolean")))
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    keepers = digest.join(repeated, "fp", "left_semi").groupBy("text_sha256").agg(first)
    groups = small(written(verified.join(keepers, "text_sha256").select("text_sha256", "group_size", "first"), "groups"), 160)
    return digest.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("first").isNull(), True).otherwise(F.col("first.rid") == F.col("rid")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns as they are, whatever their names.

    Repeated rows that tie for their group's place leave one row.
    """
    decided = written(exact_dedup(docs, id_col, text_col), "decided")
    own, gone_id, gone_sha, tie = free_names(docs, "sha", "gone_id", "gone_sha", "tied")
    gone = decided.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(tie))
    gone = written(gone.distinct(), "gone")
    keyed = docs.withColumn(own, F.sha2(normalised(text_col), 256))
    match = keyed[id_col].eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha))
    left = keyed.join(small(gone.filter(~F.col(tie)), 120), match, "left_anti")
    tied = gone.filter(F.col(tie))
    if tied.isEmpty():
        return left.select(named_columns(docs))
    tied = small(tied, 120)
    single = left.join(tied, match, "left_anti")
    once = left.join(tied, match, "left_semi").dropDuplicates([id_col, own])
    return single.unionByName(once).select(named_columns(docs))
