"""Phrase mining by suffix-sigma: truncated suffixes are sorted in reverse, and one stack counts all their prefixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, text_of, written

#: Bytes of text that a task counts in memory at a time.
UNIT_BYTES = 8 << 20
#: Suffixes that a task is meant to sort.
TASK_ROWS = 1 << 20
#: Parts of a language whose best phrases are found before they are put together.
RANK_PARTS = 64

#: Between the words of a key: the least byte, so that keys sort as lists of words do.
_SEP = b"\x00"
#: Lower case, one byte for all ends of pieces and one for all white space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _escaped(words: pa.Array) -> pa.Array:
    """Words without the separator's byte, in the same order."""
    out = pc.replace_substring(words, pattern=b"\x01", replacement=b"\x01\x02")
    return pc.replace_substring(out, pattern=b"\x00", replacement=b"\x01\x01")


def _unescaped(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01") if b"\x01" in word else word


class Unit(NamedTuple):
    """Texts of a language as one run of coded words; pieces end at code -1."""

    codes: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, texts: list[bytes]) -> Unit:
        body = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([body], pa.large_binary()), b" ").flatten()
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        new = np.full(len(words), -2, np.int64)
        real = ~np.isin(np.arange(len(words)), [words.index(b"").as_py(), words.index(b"\n").as_py()])
        new[real] = np.arange(real.sum())
        at_end = words.index(b"\n").as_py()
        if at_end >= 0:
            new[at_end] = -1
        codes = new[coded.indices.to_numpy()]
        return cls(codes[codes != -2], words.filter(pa.array(real)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Unit]]:
    """Units of the batches' (lang, text), by language."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            held[lang].append(raw := text.as_py())
            size += len(raw)
            if size >= UNIT_BYTES:
                yield from ((k, Unit.of(v)) for k, v in held.items())
                held.clear()
                size = 0
    yield from ((k, Unit.of(v)) for k, v in held.items())


def _count_words(batches):
    for lang, unit in _units(batches):
        counts = np.bincount(unit.codes[unit.codes >= 0], minlength=len(unit.words))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "word": unit.words.cast(pa.string()), "n": pa.array(counts, pa.int64())})


def _suffixes(unit: Unit, frequent: pa.Array | None, max_n: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """Distinct suffixes of two words or more, cut at ``max_n`` words and before words that aren't frequent: columns of codes (-1: none), counts, words."""
    codes, words = unit.codes, unit.words
    if frequent is not None:
        keep = pc.is_in(words, value_set=frequent).to_numpy(zero_copy_only=False)
        new = np.full(len(words) + 1, -1, np.int64)
        new[:-1][keep] = np.arange(keep.sum())
        codes, words = new[codes], words.filter(pa.array(keep))
    # in the words' order, so that neighbors share their beginnings and rows pack well
    order = pc.sort_indices(words).to_numpy()
    new = np.full(len(words) + 1, -1, np.int64)
    new[order] = np.arange(len(words))
    codes, words = new[codes], words.take(pa.array(order))
    n, base = len(codes), len(words) + 1
    ends = np.where(codes < 0, np.arange(n), n)
    length = np.minimum(np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n), max_n)
    at = np.flatnonzero(length >= 2)
    padded = np.concatenate([codes, np.full(max_n, -1, np.int64)])
    columns = [np.where(length[at] > j, padded[at + j], -1) + 1 for j in range(max_n)]
    if base**max_n < 2**63:
        key = columns[0]
        for c in columns[1:]:
            key = key * base + c
        key, counts = np.unique(key, return_counts=True)
        out = []
        for _ in range(max_n):
            out.append(key % base - 1)
            key //= base
        return out[::-1], counts, words
    # codes of ever longer prefixes, so that any number of words fits
    key = columns[0]
    for c in columns[1:]:
        _, key = np.unique(key * base + c, return_inverse=True)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [c[first] - 1 for c in columns], counts, words


class PrefixStack:
    """Counts of all prefixes of sorted keys: one open prefix for each length.

    A prefix is closed as soon as a key comes that doesn't start with it. The
    first and last of each length may go on in a neighboring task, so that they are
    given out whatever their count; of all others only those with ``least``.
    """

    def __init__(self, max_n: int, least: int) -> None:
        self.least = least
        self.max_n = max_n
        self.open: list[tuple[tuple[bytes, ...], int] | None] = [None] * max_n
        self.fresh = [True] * max_n
        self.out: list[tuple[str, str, int, int]] = []

    def close(self, depth: int, at_edge: bool = False) -> None:
        held = self.open[depth]
        if held is not None:
            if at_edge or self.fresh[depth] or held[1] >= self.least:
                lang, *words = (_unescaped(x).decode() for x in held[0])
                self.out.append((lang, " ".join(words), depth + 1, held[1]))
            self.fresh[depth] = False
            self.open[depth] = None

    def add(self, keys: pa.Array, counts: np.ndarray) -> None:
        """Goes on with sorted keys, a language and words each; runs of equal prefixes inside a batch are summed at once."""
        parts = pc.split_pattern(keys, _SEP)
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        codes = parts.flatten().dictionary_encode().indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(counts)])
        changed = np.concatenate([[True], codes[start[1:]] != codes[start[:-1]]])
        for depth in range(self.max_n):
            has = size > depth + 1
            column = np.where(has, codes[np.minimum(start + depth + 1, len(codes) - 1)], -1)
            changed[1:] |= column[1:] != column[:-1]
            runs = np.flatnonzero(changed)
            sums = np.diff(upto[np.append(runs, len(size))])
            real = has[runs]
            # only a run at an edge of the batch may go on in what came or comes
            big = np.flatnonzero(real & (sums >= self.least) | (np.arange(len(runs)) == 0) | (np.arange(len(runs)) == len(runs) - 1))
            for k in big:
                if not real[k]:
                    self.close(depth)
                    continue
                prefix = tuple(keys[int(runs[k])].as_py().split(_SEP)[: depth + 2])
                held = self.open[depth]
                if held is not None and held[0] == prefix:
                    self.open[depth] = (prefix, held[1] + int(sums[k]))
                else:
                    self.close(depth)
                    self.open[depth] = (prefix, int(sums[k]))

    def finish(self) -> None:
        for depth in range(self.max_n):
            self.close(depth, at_edge=True)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[], [], [], []]
        self.out = []
        kinds = [("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("a", pa.int64())]
        return pa.RecordBatch.from_pydict({name: pa.array(column, kind) for (name, kind), column in zip(kinds, columns, strict=True)})


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 4, least: int = 30, cover_percent: int = 80, top: int = 2000,
) -> DataFrame:
    """The phrases of each language whose words keep most to each other.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line
    ends, and pieces into words at spaces and tabs. A candidate is a phrase of 2
    to ``max_n`` words that occurs ``least`` times. Its score is that of its worst cut in
    two, ``floor(2000000 a / (l + r))`` of the counts of the whole and both parts. Candidates
    that stand inside a longer one with ``cover_percent`` of their count are dropped.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all
    words of the language) and ``score``: the first ``top`` of each language by score,
    count, and phrase in byte order. A null text is empty, and a null language ``und``.
    Repeated rows count as often as they stand. Texts may be of any length. An
    empty table gives an empty result; other columns aren't read.

    Suffixes are counted in each task before they are dealt by ranges of
    language and words, so that the suffixes of a frequent first word are shared by many
    tasks; prefixes at the edges of tasks are added up afterwards. Where the frequent words
    fit a broadcast (counted first), suffixes are cut before other words, none of which a
    candidate can hold; else they go whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    words = written(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= least)

    by_lang: dict[str, pa.Array] | None = None
    if (frequent.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        lists = defaultdict(list)
        for lang, word in frequent.select("lang", "word").collect():  # at most BROADCAST_BYTES, as counted
            lists[lang].append(word.encode())
        by_lang = {lang: pa.array(held, pa.binary()) for lang, held in lists.items()}
    shared = spark.sparkContext.broadcast(by_lang)

    def emit(batches):
        vocabulary = shared.value
        none = pa.array([], pa.binary())
        for lang, unit in _units(batches):
            columns, counts, held = _suffixes(unit, None if vocabulary is None else vocabulary.get(lang, none), max_n)
            held = _escaped(held)
            name = _escaped(pa.array([lang.encode()], pa.binary()))[0]
            parts = [held.take(pa.array(c, pa.int64(), mask=c < 0)) for c in columns]
            keys = pc.binary_join_element_wise(name, *parts, pa.scalar(_SEP, pa.binary()), null_handling="skip")
            yield pa.RecordBatch.from_pydict({"key": keys, "n": pa.array(counts, pa.int64())})

    def count(batches):
        stack = PrefixStack(max_n, least)
        for batch in batches:
            if batch.num_rows:
                stack.add(batch.column(0), batch.column(1).to_numpy())
                yield stack.batch()
        stack.finish()
        yield stack.batch()

    suffixes = written(rows.mapInArrow(emit, "key binary, n long"), "suffixes", "zstd")
    tasks = suffixes.count() // TASK_ROWS + 1
    dealt = suffixes.repartitionByRange(tasks, "key").sortWithinPartitions(F.col("key").desc())
    prefixes = dealt.mapInArrow(count, "lang string, phrase string, k int, a long").filter("k > 1")
    grams = written(prefixes.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "grams")
    counted = grams.select("lang", "phrase", "a").union(frequent.select("lang", F.col("word").alias("phrase"), "a"))

    def part(array, start, size):
        return F.array_join(F.slice(array, start, size), " ")

    listed = grams.withColumn("ws", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(F.col("ws"), i, m))))
    longer = listed.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    left = listed.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (exact("longest", 100) < exact("a", cover_percent)))

    cuts = left.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("c"), part(F.col("ws"), F.lit(1), c).alias("one"), part(F.col("ws"), c + 1, F.col("k") - c).alias("two")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.c", "cut.one", "cut.two")
    cuts = cuts.join(counted.toDF("lang", "one", "l"), ["lang", "one"]).join(counted.toDF("lang", "two", "r"), ["lang", "two"])
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = F.min(F.struct(score.alias("score"), "c", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
