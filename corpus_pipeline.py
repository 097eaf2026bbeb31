"""The corpus pipeline: stages over ``documents``, each written and read again.

Null texts count as empty in every stage and null ids and sources are values of
their own; an empty table runs through to an empty result. Other columns of
``documents``, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_paths, free_names, made_paths, named_columns, small, table, text_of, written
from quire.llm.exact_dedup import keep_first
from quire.llm.mixing import mix_sources
from quire.llm.near_dedup import keep_one
from quire.llm.packing import pack_documents
from quire.llm.toxicity import keep_civil, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; its lexicon is learned from ``labels``."""
    return keep_civil(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the document with the smallest id stays."""
    return keep_one(docs, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes: none, one or two.

    Rows that repeat id, source and text share their copies evenly, rounded.
    """
    mixed = mix_sources(docs)
    own, copy, doc_id, source, text_fp, copies = free_names(docs, "fp", "copy", "doc_id", "source", "text_fp", "copies")
    taken = mixed.groupBy("doc_id", "source", "text_fp").agg(F.round(F.avg("copies")).cast("int").alias("copies")).filter("copies > 0")
    taken = small(written(taken.toDF(doc_id, source, text_fp, copies), "copies"), 60)
    printed = docs.withColumn(own, F.xxhash64(text_of("text")))
    same = printed["doc_id"].eqNullSafe(F.col(doc_id)) & printed["source"].eqNullSafe(F.col(source)) & (F.col(own) == F.col(text_fp))
    each = printed.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return each.select(named_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins; copies of a document never share one."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Learned scores and signatures are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of ``documents``.

    Tables that only earlier stages read are deleted as soon as a stage is written.
    """
    docs = table(spark, sf_dir, "documents")
    made = made_paths(spark)
    since = len(made)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            drop_paths(spark, made[since:-1])
    return docs
