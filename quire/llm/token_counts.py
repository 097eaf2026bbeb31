"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of

#: Counts of pre-tokens that a worker remembers at most.
REMEMBERED = 300_000
#: Characters of text whose new pre-tokens are merged together.
CHUNK_CHARS = 4 << 20
NEVER = np.int64(1) << 40


class PieceRanks:
    """A byte-fallback BPE model: ranks of mergeable pairs, and what each symbol counts.

    A pair merges if its joined text is a piece; the better the piece's score,
    the lower the rank. Symbols are pieces, and characters that only occur
    inside pieces. A symbol left over counts 1 if it is a piece, else its UTF-8
    bytes, which is what byte fallback makes of it.

    A symbol is ``hasty`` if a pair with it can have a rank no higher than the
    merge that made it. Other merges of one rank don't stand in each other's way.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.symbol = {p: k for k, (p, _) in enumerate(pieces)}
        self.texts = [p for p, _ in pieces]
        for p, _ in pieces:
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = len(self.texts)
                    self.texts.append(c)
        self.cost = np.array([1 if k < len(pieces) else len(t.encode()) for k, t in enumerate(self.texts)] + [0], np.int64)
        self.unknown = len(self.texts)
        scores = sorted({s for _, s in pieces}, reverse=True)
        by_score = {s: k for k, s in enumerate(scores)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for merged, (p, score) in enumerate(pieces):
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    self.pairs[self.key(a, b)] = (by_score[score], merged)
        self.hasty = np.zeros(len(self.texts) + 1, bool)
        made = [by_score[x] for _, x in pieces]
        for key, (rank, _) in self.pairs.items():
            for part in (key >> 20, key & ((1 << 20) - 1)):
                if part < len(pieces) and rank <= made[part]:
                    self.hasty[part] = True
        #: characters that stand side by side in some piece; nothing merges over others
        beside = {self.key(self.symbol[a], self.symbol[b]) for p, _ in pieces for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.int64)
        self.inside = {c for p, _ in pieces if len(p) > 1 for c in p}
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for t, k in self.symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = k
        self._index()

    @classmethod
    def load(cls, path: str) -> PieceRanks:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation, dummy prefix and byte fallback are counted here")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == p.NORMAL]
        if any("▁" in p.lstrip("▁") for p, _ in pieces):
            raise ValueError("pieces that go on after a space are not supported")
        return cls(pieces)

    @staticmethod
    def key(a, b):
        return (a << 20) | b

    def _index(self) -> None:
        """The pairs as two hash tables without chains: what collides in the first goes to the second."""
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        values = np.array(list(self.pairs.values()), np.int64).reshape(-1, 2)
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            slots = self._slots(keys, factor)
            _, first = np.unique(slots, return_index=True)
            held = np.full(1 << 20, -1, np.int64)
            rank = np.full(1 << 20, NEVER, np.int64)
            merged = np.zeros(1 << 20, np.int32)
            held[slots[first]], rank[slots[first]], merged[slots[first]] = keys[first], values[first, 0], values[first, 1]
            self.tables.append((factor, held, rank, merged))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, values = keys[rest], values[rest]
            if not len(keys):
                return
        raise ValueError("pairs collide in all tables")

    @staticmethod
    def _slots(keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(44)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if the pair doesn't merge) and merged symbol of each pair."""
        keys = self.key(a.astype(np.int64), b.astype(np.int64))
        rank = np.full(len(keys), NEVER, np.int64)
        merged = np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for factor, held, ranks, results in self.tables:
            slots = self._slots(keys[open_], factor)
            hit = held[slots] == keys[open_]
            rank[open_[hit]] = ranks[slots[hit]]
            merged[open_[hit]] = results[slots[hit]]
            open_ = open_[~hit]
        return rank, merged

    def counts(self, tokens: list[str]) -> np.ndarray:
        """How many symbols are left of each pre-token (spaces as U+2581)."""
        total = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        full = np.flatnonzero(lengths)
        if len(full):
            total[full] = self._merge("".join(tokens), lengths[full])
        return total

    def _merge(self, joined: str, lengths: np.ndarray) -> np.ndarray:
        """Merges all pre-tokens together; in a round, every pair of the lowest rank that its sequence has.

        Sequences are the pre-tokens, parted where two characters stand side by
        side in no piece. Of pairs that overlap every second one from the left
        merges. A hasty symbol might merge on before other pairs of its rank
        do, so that of those the first alone merges in a round.
        """
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sym = self.of_char[points]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        total = np.zeros(len(lengths), np.int64)
        strange = sym == self.unknown
        if strange.any():
            p = points[strange]
            total += np.bincount(owner[strange], 1 + (p > 0x7F) + (p > 0x7FF).astype(np.int64) + (p > 0xFFFF), len(lengths)).astype(np.int64)
        inner = np.zeros(len(sym), bool)
        inner[:-1] = owner[1:] == owner[:-1]
        at = np.flatnonzero(inner)
        if len(at):
            pairs = self.key(sym[at].astype(np.int64), sym[at + 1].astype(np.int64))
            inner[at] = self.beside[np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)] == pairs
        part = np.cumsum(np.r_[0, ~inner[:-1]])
        rank = np.full(len(sym), NEVER, np.int64)
        merged = np.zeros(len(sym), np.int32)
        at = np.flatnonzero(inner)
        rank[at], merged[at] = self.find(sym[at], sym[at + 1])
        while True:
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sizes = np.diff(np.r_[starts, len(part)])
            best = np.minimum.reduceat(rank, starts)
            going = best < NEVER
            if not going.all():
                done = np.repeat(~going, sizes)
                total += np.bincount(owner[done], self.cost[sym[done]], len(lengths)).astype(np.int64)
                if not going.any():
                    return total
                keep = ~done
                sym, owner, part, rank, merged = sym[keep], owner[keep], part[keep], rank[keep], merged[keep]
                sizes, best = sizes[going], best[going]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            hasty = self.hasty[merged[at]]
            if hasty.any():
                at = at[~hasty | np.r_[True, part[at[1:]] != part[at[:-1]]]]
            place = np.arange(len(at))
            first = np.r_[True, np.diff(at) != 1]
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, part, rank, merged = sym[keep], owner[keep], part[keep], rank[keep], merged[keep]
            at = moved[at]
            last = np.r_[part[1:] != part[:-1], True]
            rank[last] = NEVER
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[at[at > 0] - 1] = True
            changed = np.flatnonzero(changed & ~last)
            rank[changed], merged[changed] = self.find(sym[changed], sym[changed + 1])


_RUNS = re.compile(" *[^ ]+| +")


class TokenCounter:
    """Counts the tokens of texts, and remembers those of frequent pre-tokens."""

    def __init__(self, path: str):
        self.ranks = PieceRanks.load(path)
        #: by pre-token as it stands in the text, after a space, and with spaces of its own
        self.bare: dict[str, int] = {"": 0}
        self.spaced: dict[str, int] = {}
        self.split_lines = "\n" not in self.ranks.inside
        self.newline = int(self.ranks.counts(["\n"])[0])

    _held: dict[str, TokenCounter] = {}

    @classmethod
    def shared(cls, path: str) -> TokenCounter:
        """One counter per worker process, so that tasks after the first know its words."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _learn(self, bare: set[str], spaced: set[str]) -> None:
        for known, new, lead in ((self.bare, bare, ""), (self.spaced, spaced, "▁")):
            new = list(new - known.keys())
            if new:
                known.update(zip(new, self.ranks.counts([lead + w.replace(" ", "▁") for w in new]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.bare) + len(self.spaced) > REMEMBERED:
            self.bare, self.spaced = {"": 0}, {}
        cut: list[tuple[int, list, list]] = []
        bare: set[str] = set()
        spaced: set[str] = set()
        for text in texts:
            if not text:
                cut.append((0, [], []))
                continue
            lines = (" " + text.replace("▁", " ")).split("\n") if self.split_lines else [" " + text.replace("▁", " ")]
            first, rest = [], []
            for line in lines:
                if "  " in line or line.endswith(" "):
                    runs = _RUNS.findall(line)
                    first += runs
                else:
                    words = line.split(" ")
                    first.append(words[0])
                    rest += words[1:]
            bare.update(first)
            spaced.update(rest)
            cut.append((self.newline * (len(lines) - 1), first, rest))
        self._learn(bare, spaced)
        return [n + sum(map(self.bare.__getitem__, first)) + sum(map(self.spaced.__getitem__, rest)) for n, first, rest in cut]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """The tokens of each whole text: no shuffle, a row per input row.

    Columns: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` (no begin or end
    tokens) and ``over_limit``. A null or empty text has none. Repeated rows
    give equal results; an empty table an empty one; other columns aren't read.
    Workers read the model at ``model_path``, which each machine has.
    """

    def run(batches):
        counter = TokenCounter.shared(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts: list[int] = []
            held: list[str] = []
            size = 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size > CHUNK_CHARS:
                    counts += counter.count(held)
                    held, size = [], 0
            counts += counter.count(held)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    d = d.withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
