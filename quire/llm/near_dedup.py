"""MinHash near-dedup by a multi-index Hamming join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, free_names, named_columns, small, text_of, written

#: Words of a shingle.
WIDTH = 5
#: A signature's symbols, in chunks; each chunk allows this many wrong symbols.
CHUNKS, CHUNK_SYMBOLS, CHUNK_ERRORS = 12, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Pairs whose signatures differ in no more symbols than this all meet: were every
#: chunk to have more errors than it allows, there would be more in all.
GUARANTEED = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: Bits of a symbol.
SYMBOL_BITS = 16
#: Nodes of a center that a task compares with as many others of it.
BLOCK_NODES = 1000
#: Shingles whose signatures are computed together; more would leave the processor's cache.
TOGETHER = 40_000
#: Words whose hashes a worker remembers at most.
REMEMBERED = 500_000

#: Classes of hashes in which the shingles that copies lack or add are counted.
GROUPS = 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.random.default_rng(20_240_229)
_FACTORS = _MIX.integers(1, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _MIX.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_SALTS = _MIX.integers(1, 1 << 63, WIDTH + 3, dtype=np.uint64) | np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """The distinct shingles of texts, as sorted 64-bit hashes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()  # bytes are split at space and U+0009 to U+000D alone
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(h))
        if not n:
            return h
        mixed = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            mixed = _scramble(mixed * _SALTS[k] + h[k : len(h) - n + 1 + k])
        return np.unique(mixed)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingles."""
    data = shingles.tobytes()
    return xxhash.xxh3_64_intdigest(data, 1), xxhash.xxh3_64_intdigest(data, 2)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, symbols): of the least of each set's hashes under each of ``SYMBOLS`` permutations, the low ``SYMBOL_BITS`` bits.

    The permutations, of 32 bits, work on either half of a hash in turn, over the hashes of
    all sets together; no set is empty.
    """
    if not sets:
        return np.zeros((0, SYMBOLS), np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    halves = _scramble(np.concatenate(sets)).view(np.uint32).reshape(-1, 2)
    halves = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    room, high = np.empty_like(halves[0]), np.empty_like(halves[0])
    for k in range(SYMBOLS):
        np.multiply(halves[k & 1], _FACTORS[k], out=room)
        np.right_shift(room, 15, out=high)
        np.bitwise_xor(room, high, out=room)
        np.multiply(room, np.uint32(0x2C1B3C6D), out=room)
        np.bitwise_xor(room, _OFFSETS[k], out=room)
        out[:, k] = np.minimum.reduceat(room, starts)
    return out & np.uint64((1 << SYMBOL_BITS) - 1)


_SUBSETS = np.array(list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - CHUNK_ERRORS)))


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, keys) of (n, symbols): each chunk's symbols with every choice of the allowed errors left out, hashed."""
    n = len(signatures)
    chunks = _scramble(signatures).reshape(n, CHUNKS, CHUNK_SYMBOLS)
    picked = chunks[:, :, _SUBSETS]
    keys = np.broadcast_to(np.arange(CHUNKS * len(_SUBSETS), dtype=np.uint64).reshape(1, CHUNKS, -1) + np.uint64(1), picked.shape[:3]).copy()
    for k in range(picked.shape[3]):
        keys = _scramble(keys * _SALTS[k] + picked[:, :, :, k])
    return keys.reshape(n, CHUNKS * len(_SUBSETS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def digest(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: doc_id, rid, fp (of the text), n (shingles), the set's hashes and, for one row per set in a batch, its keys."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            sizes, firsts, seconds, keys, bits = [], [], [], [], []

            def finish(held):
                sigs = signatures([s for s in held if len(s)])
                low = ((sigs >> np.uint64(7)) & np.uint64(1)) << np.arange(SYMBOLS, dtype=np.uint64)
                made = zip(chunk_keys(sigs), np.bitwise_or.reduce(low, axis=1).tolist(), strict=True)
                for s in held:
                    row, bit = next(made) if len(s) else (None, 0)
                    a, b = set_hash(s)
                    sizes.append(len(s))
                    firsts.append(_signed(a))
                    seconds.append(_signed(b))
                    keys.append(None if row is None else row.tobytes())
                    bits.append(_signed(bit))

            held, size = [], 0
            for text in batch.column(3):
                held.append(shingler.shingles(text.as_py()))
                size += len(held[-1])
                if size >= TOGETHER:
                    finish(held)
                    held, size = [], 0
            finish(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(bits, pa.int64()), pa.array(keys, pa.binary())],
                ["doc_id", "rid", "fp", "n", "h1", "h2", "bits", "keys"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "rid", F.xxhash64("text").alias("fp"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, fp long, n long, h1 long, h2 long, bits long, keys binary")


def spread_keys(sets: DataFrame) -> DataFrame:
    """(key, node) for each key of each set."""

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            if len(nodes):
                per = len(keys) // len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, per))], ["key", "node"])

    return sets.select("node", "keys").mapInArrow(run, "key long, node long")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the sets in ``wanted`` (node, fp), from the texts with their fingerprint."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            found = [shingler.shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(text_of(text_col).alias("text")).withColumn("fp", F.xxhash64("text"))
    # one text a node; two texts that share all 64 bits by chance (0.03 pairs are expected in 1e9 texts) would be taken for each other here
    texts = texts.join(wanted, "fp").groupBy("node").agg(F.first("text").alias("text"))
    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the least node that each can reach.

    Large and small stars by turns, each round written to the shared folder,
    until no root is below another node; nothing is gathered per node but a
    minimum.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # of a node there is one minimum, so twice the edges bound their number
        few = edges.count() * 32 <= BROADCAST_BYTES
        light = F.broadcast if few else (lambda d: d)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("low")))
        ends = ends.groupBy("node").agg(F.sum("low").alias("n"), F.min("low").alias("low"))
        if ends.filter("n > 1 or (n > 0 and low = 0)").isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(light(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(light(least), "u")
        star = joined.select("u", F.col("m").alias("v")).unionAll(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(star.distinct(), "edges")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionAll(star.select(F.col("root").alias("node"), "root").distinct())


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets and of what they share."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    full = pairs.join(left, "a").join(right, "b")
    return full.select("a", "b", F.size("left").alias("na"), F.size("right").alias("nb"), F.size(F.array_intersect("left", "right")).alias("common"))


def similar(threshold: float) -> Column:
    """Whether a compared pair reaches the similarity, to whole percents."""
    return 100 * F.col("common") >= round(100 * threshold) * (F.col("na") + F.col("nb") - F.col("common"))


def with_centers(buckets: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, node, center) of buckets (key, node, size, least).

    A bucket's center is the node whose signature bits are closest to the
    majority's, which copies of one text have in common with it; sums of bits
    find the majority, and no bucket is gathered.
    """
    pair = buckets.filter("size = 2").select("key", "node", F.col("least").alias("center"))
    more = buckets.filter("size > 2").select("key", "node").join(facts.select("node", "bits"), "node")
    sums = [F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(SYMBOLS)]
    most = more.groupBy("key").agg(F.count("*").alias("n"), *sums)
    majority = sum((F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(SYMBOLS)), F.lit(0).cast("long"))
    most = most.select("key", majority.alias("majority"))
    off = F.bit_count(F.col("bits").bitwiseXOR(F.col("majority")))
    best = more.join(most, "key").groupBy("key").agg(F.min(F.struct(off.alias("off"), "node")).alias("best")).select("key", F.col("best.node").alias("center"))
    return pair.unionByName(more.select("key", "node").join(best, "key"))


def class_counts(values: Column) -> Column:
    """array<int>: how many hashes fall in each of ``GROUPS`` classes."""
    in_class = lambda g: lambda x: F.pmod(x, F.lit(GROUPS)) == g
    return F.array(*[F.size(F.filter(values, in_class(g))) for g in range(GROUPS)])


def strays(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(center, node, size, miss, extra) of pairs (center, node), in counts by class of hash.

    ``miss`` are the center's shingles that the node lacks, ``extra`` those of
    its own beside the center's that another node of the center has too. Of the
    center, of ``size`` shingles, two nodes share what neither lacks: at most
    its size less the greater miss of each class. Beside it they share at most
    the smaller extra of each class.
    """
    own = pairs.join(sets.select("node", F.col("shingles").alias("own")), "node").join(sets.select(F.col("node").alias("center"), "shingles"), "center")
    known = written(
        own.select("center", "node", F.size("shingles").alias("size"), class_counts(F.array_except("shingles", "own")).alias("miss"), F.array_except("own", "shingles").alias("others")),
        "known",
    )
    extra = known.select("center", "node", F.explode("others").alias("x"))
    again = extra.groupBy("center", "x").agg(F.count("*").alias("n")).filter("n > 1").select("center", "x")
    counts = [F.count_if(F.pmod("x", F.lit(GROUPS)) == g).cast("int") for g in range(GROUPS)]
    shared = extra.join(again, ["center", "x"]).groupBy("center", "node").agg(F.array(*counts).alias("extra"))
    none = F.array_repeat(F.lit(0), GROUPS)
    return known.join(shared, ["center", "node"], "left").select("center", "node", "size", "miss", F.coalesce("extra", none).alias("extra"))


def open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that have a center in common and aren't ruled out by it.

    ``placed`` has a row per center and node: center, node, root, n, bits and
    what ``strays`` found. What a node shares with any other of its center is
    bounded by itself alone, so that nodes that can reach none go before any
    are paired. The others are paired in blocks of ``BLOCK_NODES``: a task has
    two blocks at most, however many nodes a center has.
    """
    most = F.least(F.col("n"), F.col("size") + sum(F.col("extra")[g] - F.col("miss")[g] for g in range(GROUPS)))
    # another node has as many shingles as the center's least, and as many as the threshold asks for
    smallest = placed.groupBy("center").agg(F.min("n").alias("smallest"))
    able = placed.withColumn("most", most).join(smallest, "center")
    able = able.filter(100 * F.col("most") >= percent * (F.col("n") + F.greatest(F.col("smallest"), F.ceil(percent * F.col("n") / 100)) - F.col("most")))
    able = written(able.drop("smallest", "most"), "able")
    mixed = able.groupBy("center").agg(F.count("*").alias("nodes"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    able = able.join(small(written(mixed.select("center", "nodes"), "mixed"), 24), "center")
    able = able.withColumn("blocks", F.ceil(F.col("nodes") / BLOCK_NODES).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    fields = ["node", "root", "n", "bits", "size", "miss", "extra"]
    left = able.select("center", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), *[F.col(x).alias(f"{x}_a") for x in fields])
    right = able.select("center", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), *[F.col(x).alias(f"{x}_b") for x in fields if x != "size"])
    bound = F.col("size_a") + sum(F.least(F.col("extra_a")[g], F.col("extra_b")[g]) - F.greatest(F.col("miss_a")[g], F.col("miss_b")[g]) for g in range(GROUPS))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    once = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    near = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= GUARANTEED
    reach = 100 * bound >= percent * (F.col("n_a") + F.col("n_b") - bound)
    met = left.join(right, ["center", "i", "j"]).filter(once & (F.col("root_a") != F.col("root_b")) & sizes & near & reach)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """Groups documents whose sets of word shingles are similar, directly or over others.

    Words are lower-cased (A-Z) and cut at white space; a set has the distinct
    ``width``-word shingles, or the whole sequence where there are fewer words.
    Two documents are linked if the Jaccard similarity of their full sets
    reaches ``threshold``, to whole percents. Documents without words have an
    empty set and no links.

    Returns a row per input row: ``doc_id``, ``rid`` (a number of the row),
    ``n_shingles``, ``component_id`` (the smallest id reachable), ``kept``, true
    for one row of each component, and ``text_fp``, a hash of the text. A null text is an empty one. Null ids
    come after all others: a component of null ids alone has a null
    ``component_id``. Repeated rows are linked, and one of them is kept. An
    empty table gives an empty result; other columns aren't read.

    Equal sets are one node. Of each node, signature chunks with the allowed
    errors left out are the keys under which it can meet others; all pairs
    whose signatures differ in ``GUARANTEED`` symbols or fewer do. In a bucket
    of nodes with one key all are compared to its center, not to each other.
    What that joins is one component. Two nodes of different components that
    share a center are compared only if what they share with it, and of the
    rest what others have too, leaves them a chance; so a large group of copies
    costs its size, and no link of such pairs is lost.
    """
    rows = written(digest(docs, id_col, text_col, width), "digest")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    nodes = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min(first).alias("first"), F.min("rid").alias("node"), F.min_by("fp", "rid").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    lead = rows.select(F.col("rid").alias("node"), "keys").join(nodes.select("node"), "node", "left_semi")
    keys = spread_keys(lead)
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1")
    met = written(keys.join(shared, "key"), "met")
    facts = small(nodes.select("node", "n", "bits"), 24)
    buckets = written(with_centers(met, facts), "buckets")
    percent = round(100 * threshold)
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # each bit is of another symbol: where more differ, the signatures are farther apart than what is searched
    bits = F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= GUARANTEED

    pairs = buckets.filter("node <> center").select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    pairs = pairs.join(facts.toDF("a", "na", "ba"), "a").join(facts.toDF("b", "nb", "bb"), "b").filter(sizes & bits).select("a", "b")
    members = written(nodes.select("node", "fp").join(buckets.select("node").distinct(), "node", "left_semi"), "members")
    sets = written(sets_of(docs, small(members, 16), text_col, width), "sets")
    found = written(compared(pairs, sets), "found")
    links = found.filter(similar(threshold)).select("a", "b")
    roots = small(written(components(links), "roots"), 16)

    # buckets of three and more whose nodes are still of several components
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    mixed = small(written(mixed.filter("low <> high and size > 2").select("key"), "mixed"), 8)
    # all were compared with the center; one center often serves many keys
    placed = written(placed.filter("node <> center").join(mixed, "key", "left_semi").select("center", "node", "root").distinct(), "placed")
    if not placed.isEmpty():
        stray = written(strays(placed.select("center", "node"), sets), "strays")
        more = open_pairs(placed.join(facts, "node").join(stray, ["center", "node"]), percent)
        more = written(more.join(small(found.select("a", "b"), 16), ["a", "b"], "left_anti"), "more")
        new = written(compared(more, sets).filter(similar(threshold)).select("a", "b"), "links")
        if not new.isEmpty():
            roots = small(written(components(links.unionAll(new)), "roots"), 16)

    lows = nodes.join(roots, "node").groupBy("root").agg(F.min("first").alias("first")).select("root", "first")
    low = roots.join(lows, "root").select("node", "first")
    groups = nodes.select("h1", "h2", "node", F.col("first").alias("own")).join(low, "node", "left").select("h1", "h2", F.coalesce("first", "own").alias("first"))
    alone = rows.filter("n = 0").select("doc_id", "rid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("fp").alias("text_fp"))
    full = rows.filter("n > 0").join(small(written(groups, "groups"), 100), ["h1", "h2"])
    full = full.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("first.rid") == F.col("rid")).alias("kept"), F.col("fp").alias("text_fp"))
    return full.unionAll(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, all columns as they are.

    Rows are told apart by id and text; of rows that are equal in both and have
    words, one stays at most.
    """
    decided = near_dedup(docs, id_col, text_col, threshold)
    own, gone_id, gone_text, left_over = free_names(docs, "fp", "gone_id", "gone_text", "kept")
    kept = F.sum(F.col("kept").cast("int"))
    rows = decided.groupBy("doc_id", "text_fp").agg(kept.alias("kept"), F.count("*").alias("rows")).filter("kept < rows")
    rows = written(rows.select(F.col("doc_id").alias(gone_id), F.col("text_fp").alias(gone_text), F.col("kept").alias(left_over)), "gone")
    keyed = docs.withColumn(own, F.xxhash64(text_of(text_col)))
    same = keyed[id_col].eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_text))
    left = keyed.join(small(rows.filter(F.col(left_over) == 0), 32), same, "left_anti")
    tied = rows.filter(F.col(left_over) > 0)
    if tied.isEmpty():
        return left.select(named_columns(docs))
    tied = small(tied, 32)
    single = left.join(tied, same, "left_anti")
    return single.unionByName(left.join(tied, same, "left_semi").dropDuplicates([id_col, own])).select(named_columns(docs))
