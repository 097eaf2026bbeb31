"""Repeated passages: suffix buckets are sorted one at a time, and a difference cover's sample settles long ties."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_paths, new_path, small_batches, text_of, written

#: Bytes of texts in a block, what a task works on at a time; a longer text is a block by itself.
BLOCK_BYTES = 2 << 20
#: Blocks of a unit, which stay together in a file.
UNIT_BLOCKS = 8
#: Bytes of texts that a bucket of the table of blocks is meant to hold, and the most buckets.
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 50_000
#: Suffixes that are sorted at a time.
PART_ROWS = 1 << 19
#: Blocks that go to Python at a time.
BLOCK_ROWS = 8
#: Bytes that are fingerprinted at a time.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


@lru_cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """(v, places): a perfect difference set modulo the largest v up to ``most`` that a small plane over a prime field has.

    Any two residues have a shift below v that takes both into the set: the
    points of a line in the plane, as powers of a root of a cubic.
    """
    primes = [q for q in range(2, 60) if all(q % d for d in range(2, q)) and q * q + q + 1 <= most]
    if not primes:
        raise ValueError("passages of at least 14 bytes can be compared")
    q = primes[-1]
    v = q * q + q + 1
    for a, b, c in itertools.product(range(q), repeat=3):
        x, places = (1, 0, 0), []
        for i in range(v):
            if x[2] == 0:
                places.append(i)
            x = (-c * x[2] % q, (x[0] - b * x[2]) % q, (x[1] - a * x[2]) % q)
        if len(places) == q + 1 and len({(i - j) % v for i in places for j in places}) == v:
            return v, np.array(places, np.int64)
    raise AssertionError("every prime field has such a cubic")


class Prints:
    """Two 64-bit fingerprints of byte strings, from running sums of weighted bytes; the weights are fixed pseudo-random values."""

    BASES = (6364136223846793005, 3935559000370003845)

    def __init__(self, longest: int) -> None:
        n = CHUNK_BYTES + longest + 1
        letters = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64)
        self.tables = [(row, self._powers(base, n), self._powers(pow(base, -1, 2**64), n)) for row, base in zip(letters, self.BASES, strict=True)]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(pow(base, done, 2**64))
            done += more
        return out

    def of(self, body: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: int = 2) -> list[np.ndarray]:
        """Fingerprints of the strings that begin at ``start``, which ascends, and have ``size`` bytes."""
        out = [np.empty(len(start), np.uint64) for _ in range(hashes)]
        at = 0
        while at < len(start):
            first = int(start[at])
            to = int(np.searchsorted(start, first + CHUNK_BYTES))
            own, ends = start[at:to] - first, start[at:to] - first + size[at:to]
            piece = body[first : first + int(ends.max())]
            for found, (letters, powers, inverse) in zip(out, self.tables, strict=False):
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(letters[piece] * powers[: len(piece)], out=sums[1:])
                x = (sums[ends] - sums[own]) * inverse[own]
                x ^= x >> _U(32)
                x *= _U(0x9E3779B97F4A7C15)
                x ^= x >> _U(29)
                x *= _U(0xBF58476D1CE4E5B9)
                found[at:to] = x ^ (x >> _U(32))
            at = to
        return out


class Distinct(NamedTuple):
    """Rows of columns without repeats, in order; which of them each row is, and how often each stands."""

    columns: list[np.ndarray]
    inverse: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, columns: list[np.ndarray]) -> Distinct:
        order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
        placed = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([c[1:] != c[:-1] for c in placed], axis=0)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return cls([c[new] for c in placed], inverse, np.bincount(inverse, minlength=int(new.sum())))


class Bits(NamedTuple):
    """What the parts answer for each distinct entry of a block: whether another block has it, and whether it is to be compared further."""

    again: np.ndarray
    further: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, replies: list[dict] | None) -> Bits:
        again, further = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for x in replies or ():
            at, to = np.searchsorted(keys, [_U(x["part"]) << _U(32), _U(x["part"] + 1) << _U(32)])
            for out, packed in ((again, x["again"]), (further, x["further"])):
                out[at:to] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(to - at)).view(bool)
        return cls(again, further)


class Finder:
    """The stages' work on a block, in a worker.

    A passage of ``length`` bytes at i and an equal one at j share a shift
    below v that takes both to places of the cover, where ``m`` bytes are left of the
    passage. So only suffixes before a cover place whose ``m`` bytes occur again
    can tie, and only the ties at places whose surroundings differ need sorting.
    """

    _shared: dict[tuple[int, int], Finder] = {}

    def __init__(self, length: int, parts: int) -> None:
        self.length, self.parts = length, parts
        self.v, self.places = difference_cover(length // 2)
        self.m, self.reach = length - self.v + 1, self.v - 1
        self.prints = Prints(length + self.reach)
        self.pattern = self.places

    @classmethod
    def shared(cls, length: int, parts: int) -> Finder:
        if (length, parts) not in cls._shared:
            cls._shared[length, parts] = cls(length, parts)
        return cls._shared[length, parts]

    def key(self, prints: np.ndarray) -> np.ndarray:
        """The part of a fingerprint, by its upper half, before its lower half."""
        return (((prints >> _U(32)) * _U(self.parts)) & ~_LOW) | (prints & _LOW)

    def cover(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, text's start, text's end) of the cover in all texts that are long enough."""
        sizes = np.diff(ends, prepend=0)
        longest = int(sizes.max(initial=0))
        while len(self.pattern) * self.v // len(self.places) < longest:
            self.pattern = np.concatenate([self.pattern, self.pattern + len(self.pattern) // len(self.places) * self.v])
        held = np.flatnonzero(sizes >= self.length)
        counts = np.searchsorted(self.pattern, sizes[held] - self.m, side="right")
        starts = (ends - sizes)[held]
        place = np.concatenate([self.pattern[:n] + s for n, s in zip(counts, starts, strict=True)] or [np.empty(0, np.int64)])
        return place, np.repeat(starts, counts), np.repeat(ends[held], counts)

    def sample(self, body: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], Distinct]:
        """The cover's places and the keys of their ``m`` bytes."""
        places = self.cover(ends)
        keys = self.key(self.prints.of(body, places[0], np.full(len(places[0]), self.m), 1)[0])
        return list(places), Distinct.of([keys])

    def repeated(self, body: np.ndarray, ends: np.ndarray, first: list[dict] | None) -> tuple[list[np.ndarray], Distinct]:
        """The places whose ``m`` bytes occur again, with the fingerprints of all that a passage through them can reach."""
        places, sample = self.sample(body, ends)
        again = ((sample.counts > 1) | Bits.of(sample.columns[0], first).again)[sample.inverse]
        place, start, end = (x[again] for x in places)
        low = np.maximum(place - self.reach, start)
        high = np.minimum(place + self.m + self.reach, end)
        around = self.prints.of(body, low, high - low)
        # contexts that texts' ends cut short are equal only if they are cut alike
        around[0] = around[0] + (place - low).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        return [place, start, end], Distinct.of([sample.columns[0][sample.inverse[again]], *around])

    def ranges(self, places: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the passages through chosen places."""
        place, start, end = (x[chosen] for x in places)
        first, last = np.maximum(place - self.reach, start), np.minimum(place, end - self.length)
        real = first <= last
        return first[real], last[real]

    def edges(self, body: np.ndarray, ends: np.ndarray, first: list[dict] | None, second: list[dict] | None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, Distinct]:
        """The ranges of passages that the sample settles as repeated; the starts of those that need sorting, and their fingerprints."""
        places, around = self.repeated(body, ends, first)
        bits = Bits.of(around.columns[0], second)
        settled = self.ranges(places, ((around.counts > 1) | bits.again)[around.inverse])
        at = np.flatnonzero(_covered(len(body), *self.ranges(places, bits.further[around.inverse])))
        one, two = self.prints.of(body, at, np.full(len(at), self.length))
        return settled, at, Distinct.of([self.key(one), two])

    def removed(self, body: np.ndarray, ends: np.ndarray, *replies: list[dict] | None) -> np.ndarray:
        """Whether each byte lies in a passage that occurs again."""
        (low, high), at, passages = self.edges(body, ends, *replies[:2])
        again = at[((passages.counts > 1) | Bits.of(passages.columns[0], replies[2]).again)[passages.inverse]]
        return _covered(len(body), np.concatenate([low, again]), np.concatenate([high, again]) + self.length - 1)


def _covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in a range from ``first`` to ``last``."""
    change = np.bincount(first, minlength=size + 1) - np.bincount(last + 1, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


_ENTRY = "part int, unit long, no int, entries binary"
_REPLY = "unit long, no int, part int, again binary, further binary"


def _entries(unit: int, no: int, distinct: Distinct) -> Iterator[tuple]:
    """A row for each part that a block has entries of: lower halves of keys, then the other columns."""
    keys = distinct.columns[0]
    if not len(keys):
        return
    parts, at = np.unique(keys >> _U(32), return_index=True)
    for part, a, b in zip(parts.tolist(), at, np.append(at[1:], len(keys)), strict=True):
        yield part, unit, no, b"".join([(keys[a:b] & _LOW).astype("<u4").tobytes(), *(c[a:b].astype("<u8").tobytes() for c in distinct.columns[1:])])


def _answered(columns: int):
    """Sorts a part's entries and answers each of its blocks."""

    def run(part: pa.Table) -> pa.Table:
        raw = part.column("entries").to_pylist()
        sizes = np.array([len(x) // (4 + 8 * (columns - 1)) for x in raw])
        held = [np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(raw, sizes, strict=True)]).astype(np.uint64)]
        held += [np.concatenate([np.frombuffer(x, "<u8", n, 4 * n + 8 * n * k) for x, n in zip(raw, sizes, strict=True)]) for k in range(columns - 1)]
        whole = Distinct.of(held)
        again = (whole.counts > 1)[whole.inverse]
        # a key with several contexts: the first block of each context stands for it
        of_key = np.bincount(np.searchsorted(np.unique(held[0]), whole.columns[0]))
        mixed = (of_key > 1)[np.searchsorted(np.unique(held[0]), held[0])]
        first = np.zeros(len(again), bool)
        first[np.unique(whole.inverse, return_index=True)[1]] = True
        further = mixed & first
        at = np.concatenate([[0], np.cumsum(sizes)])
        some = [k for k in range(len(raw)) if again[at[k] : at[k + 1]].any() or further[at[k] : at[k + 1]].any()]
        bits = lambda x: pa.array([np.packbits(x[at[k] : at[k + 1]]).tobytes() for k in some], pa.binary())
        kept = part.take(pa.array(some, pa.int64()))
        return pa.table({"unit": kept["unit"], "no": kept["no"], "part": kept["part"], "again": bits(again), "further": bits(further)})

    return run


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """(unit, no, ids, ends, body): texts one after another, as they stand in the partitions of (doc_id, text)."""

    def run(batches):
        task = TaskContext.get().partitionId() << 24
        made = itertools.count()

        def block(ids, ends, body):
            k = next(made)
            columns = [pa.array([task + k // UNIT_BLOCKS], pa.int64()), pa.array([k % UNIT_BLOCKS], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(body)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["unit", "no", "ids", "ends", "body"])

        ids, ends, body, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = text.as_py()
                if size and size + len(raw) > BLOCK_BYTES:
                    yield block(pa.array(ids, kind), ends, body)
                    ids, ends, body, size = [], [], [], 0
                size += len(raw)
                ids.append(doc_id)
                ends.append(size)
                body.append(raw)
        if ids:
            yield block(pa.array(ids, kind), ends, body)

    return docs.mapInArrow(run, f"unit long, no int, ids array<{id_type}>, ends array<long>, body binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, texts: bool = False) -> DataFrame:
    """Removes every byte of a passage of ``length`` bytes that starts anywhere else too.

    Returns a row per input row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal runs of removed bytes), ``kept_sha256`` of the bytes that are
    left, ``spans`` (start, end; in bytes) and, with ``texts``, those bytes as
    ``kept`` (binary, since a cut may part a character). Passages lie within a text;
    a text's own repeats and overlaps count, and all are judged on the
    input. Null and empty texts have nothing; texts shorter than ``length`` stay. Equal
    rows repeat each other, so that nothing of them stays if they are long enough. Texts
    may be of any length up to Spark's for a value. An empty table gives an empty
    result; other columns, whatever their names, aren't read.

    Texts are written once as blocks, in buckets, and aren't shuffled: what
    moves are fingerprints of the cover's places, about one in 13 bytes, and bits that
    answer them. Each part of the fingerprints is sorted by itself. Fingerprints that decide
    have 96 bits or more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    v, places = difference_cover(length // 2)
    parts = total * len(places) // v // PART_ROWS + 1
    path, name = new_path(spark, "blocks"), f"quire_blocks_{uuid.uuid4().hex}"
    kept_type = ", kept binary" if texts else ""

    def stage(columns: int, found):
        """The replies to what ``found`` gives of each block, by block."""

        def emit(batches):
            finder = Finder.shared(length, parts)
            for batch in batches:
                out = [row for x in _block_rows(batch) for row in _entries(x["unit"], x["no"], found(finder, x))]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "unit", "no", "entries"])

        def replies(blocks: DataFrame, name: str) -> DataFrame:
            answered = blocks.mapInArrow(emit, _ENTRY).groupBy("part").applyInArrow(_answered(columns), _REPLY)
            answered = written(answered, name)
            return answered.groupBy("unit", "no").agg(F.collect_list(F.struct("part", "again", "further")).alias(name))

        return replies

    def cut(batches):
        finder = Finder.shared(length, parts)
        for batch in batches:
            for x in _block_rows(batch):
                gone = finder.removed(x["body"], x["ends"], x["first"], x["second"], x["third"])
                yield _results(batch, x, gone, texts)

    def joined(blocks: DataFrame, replies: DataFrame) -> DataFrame:
        # by unit alone, as the table is bucketed; a unit has few blocks
        name = replies.columns[-1]
        small = replies.select(F.col("unit").alias("to_unit"), F.col("no").alias("to_no"), name).hint("shuffle_hash")
        return blocks.join(small, (F.col("unit") == F.col("to_unit")) & (F.col("no") - F.col("to_no") == 0), "left").drop("to_unit", "to_no")

    with small_batches(spark):
        buckets = min(total // BUCKET_BYTES + 1, MOST_BUCKETS)
        _blocks(rows, id_type).write.bucketBy(buckets, "unit").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        with small_batches(spark, BLOCK_ROWS):
            blocks = spark.table(name)
            first = stage(1, lambda finder, x: finder.sample(x["body"], x["ends"])[1])(blocks.drop("ids"), "first")
            blocks = joined(blocks, first)
            second = stage(3, lambda finder, x: finder.repeated(x["body"], x["ends"], x["first"])[1])(blocks.drop("ids"), "second")
            blocks = joined(blocks, second)
            third = stage(2, lambda finder, x: finder.edges(x["body"], x["ends"], x["first"], x["second"])[2])(blocks.drop("ids"), "third")
            blocks = joined(blocks, third)
            schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>{kept_type}"
            return written(blocks.mapInArrow(cut, schema), "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_paths(spark, [path])


def _block_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of blocks, with bytes and ends as arrays."""
    names = batch.schema.names
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k] for c in names if c != "ids"}
        out = {c: x.as_py() for c, x in row.items() if c not in ("body", "ends")}
        yield out | {"row": k, "body": np.frombuffer(row["body"].as_buffer() or b"", np.uint8), "ends": row["ends"].values.to_numpy(zero_copy_only=False)}


def _results(batch: pa.RecordBatch, block: dict, gone: np.ndarray, texts: bool) -> pa.RecordBatch:
    """A row for each text of a block, from its removed bytes."""
    body, ends = block["body"], block["ends"]
    starts = np.concatenate([[0], ends[:-1]])
    upto = np.concatenate([[0], np.cumsum(gone)])
    removed = upto[ends] - upto[starts]
    raw = memoryview(body)
    spans, digests, kept = [], [], []
    for a, b, n in zip(starts.tolist(), ends.tolist(), removed.tolist(), strict=True):
        left, runs = raw[a:b], []
        if n:
            own = gone[a:b]
            change = np.flatnonzero(np.diff(own, prepend=False, append=False))
            runs = [{"start": int(s), "end": int(e)} for s, e in change.reshape(-1, 2)]
            left = body[a:b][~own].tobytes()
        spans.append(runs)
        digests.append(hashlib.sha256(left).hexdigest())
        if texts:
            kept.append(bytes(left))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = {
        "doc_id": batch.column("ids")[block["row"]].values, "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, span),
    }
    return pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if texts else {}))
