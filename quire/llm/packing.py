"""Best-fit packing under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of, written
from quire.llm.exact_dedup import normalised
from quire.llm.mixing import word_count

#: Documents that a shard is meant to hold; a shard is packed by itself.
SHARD_ROWS = 4096


class Bins:
    """Open bins in order of residual room, each with bitmaps of its sources and duplicate clusters.

    ``planes`` bit sets say which sources a bin holds at least once, twice and
    so on, so that a source's number of pieces in a bin is bounded by the number
    of planes. One bit set says which clusters it holds.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the tightest bin with room that has no conflict, else a new one.

        The search starts at the least residual that fits and goes on to the
        next until a bin is compatible. A piece of length 0 repeats nothing and
        is of no cluster.
        """
        bit, group = 1 << source, (1 << cluster) if size and cluster >= 0 else 0
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            room, k = self.order[at]
            if not self.clusters[k] & group and not self.planes[k][-1] & bit:
                del self.order[at]
                break
        else:
            k, room = len(self.used), self.capacity
            self.planes.append([0] * self.per_source)
            self.clusters.append(0)
            self.used.append(0)
        for p in range(self.per_source):
            if not self.planes[k][p] & bit:
                self.planes[k][p] |= bit
                break
        self.clusters[k] |= group
        start = self.used[k]
        self.used[k] += size
        if room > size:
            insort(self.order, (room - size, k))
        return k, start


def pack(pieces: Iterable[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), which are placed as they come."""
    pieces = list(pieces)
    sources = {s: k for k, s in enumerate(dict.fromkeys(p[1] for p in pieces))}
    # a cluster of one piece conflicts with nothing and needs no bit
    groups = {c: k for k, c in enumerate(c for c, n in Counter(p[2] for p in pieces).items() if n > 1)}
    bins = Bins(capacity, per_source)
    return [bins.place(size, sources[source], groups.get(cluster, -1)) for size, source, cluster in pieces]


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    per_source: int = 4,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    cluster: Column | None = None,
) -> DataFrame:
    """Packs documents into bins of ``capacity`` words, best fit in order of falling size.

    A document over the capacity is cut; all its pieces but the last fill bins
    of their own, and conflict with nothing. Two pieces of one duplicate cluster
    (equal texts, unless ``cluster`` says otherwise) never share a bin, and a
    bin holds at most ``per_source`` pieces of a source.

    Returns a row per piece: ``doc_id``, ``source``, ``piece``, ``start`` (its
    first word in the document), ``length``, ``bin_id``, ``bin_start`` and
    ``bin_used``. Every document has a piece: a null or empty text one of
    length 0, which is of no cluster but counts for its source. A null source is a source. Repeated
    rows are of one cluster. Null ids are packed like others, and ids come back
    in their own type. An empty table gives an empty result; other
    columns aren't read.

    Documents are dealt at random into shards of a few thousand; bins don't
    cross shards. That costs about one half-empty bin per shard, and makes the
    work of a task bounded whatever the size of a source or cluster.
    """
    size = word_count(text_col) if size is None else size
    cluster = F.xxhash64(normalised(text_col)) if cluster is None else cluster
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), cluster.alias("cluster"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "sizes")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        # ids stay in Arrow: a null among them must not turn the others to floats
        shard = shard.sort_by([("size", "descending"), ("rid", "ascending")])
        out: list[tuple] = []
        tails: list[tuple] = []
        n = 0
        for row, full in enumerate(shard.column("size").to_pylist()):
            whole = max(0, -(-full // capacity) - 1)
            for k in range(whole):
                out.append((row, k, k * capacity, capacity, n, 0, capacity))
                n += 1
            tails.append((row, whole, whole * capacity, full - whole * capacity))
        # the tails of long documents join the order by their own size
        tails.sort(key=lambda t: -t[3])
        sources, clusters = shard.column("source").to_pylist(), shard.column("cluster").to_pylist()
        placed = pack(((t[3], sources[t[0]], clusters[t[0]]) for t in tails), capacity, per_source)
        used: Counter = Counter()
        for (k, _), t in zip(placed, tails, strict=True):
            used[k] += t[3]
        out += [(*t, n + k, start, used[k]) for t, (k, start) in zip(tails, placed, strict=True)]
        row, piece, start, length, bins, bin_start, bin_used = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
        kept = shard.select(["doc_id", "source"]).take(row)
        numbers = pa.array([(number << 32) + k for k in bins.to_pylist()], pa.int64())
        names = ["doc_id", "source", "piece", "start", "length", "bin_id", "bin_start", "bin_used"]
        return pa.table([*kept.columns, piece, start, length, numbers, bin_start, bin_used], names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source {rows.schema['source'].dataType.simpleString()}, piece long, start long, length long, bin_id long, bin_start long, bin_used long"
    return rows.groupBy("shard").applyInArrow(run, schema)


def bin_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, text) with each bin's pieces in their order, for tables whose ids are unique."""
    from quire.llm.common import WS_RUN

    words = F.array_remove(F.split(text_of(text_col), WS_RUN), "")
    cut = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).join(packed, "doc_id")
    cut = cut.withColumn("part", F.concat_ws(" ", F.slice("words", F.col("start").cast("int") + 1, F.col("length").cast("int"))))
    parts = F.sort_array(F.collect_list(F.struct("bin_start", "doc_id", "part")))
    return cut.groupBy("bin_id").agg(F.concat_ws("\n\n", parts["part"]).alias("text"))
