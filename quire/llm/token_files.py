"""Token ids of documents in sorted-string-table shards, written and read back."""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import text_of, written
from quire.llm.sstable import Reader, Writer, id_key, key_id

#: Words with their space whose ids a worker remembers at most.
REMEMBERED = 1_000_000
#: Characters of text that are cut and encoded together.
CHUNK_CHARS = 8 << 20
#: Words in one call of the library.
CALL_WORDS = 64
#: Words whose ids are gathered at once.
GATHER_WORDS = 1 << 20

#: White space but newlines, with the separators that the regular expressions of Python or the library take for it.
_BLANK = r"[\t\v\f\r\x1c-\x20\x{85}\p{Z}]"
#: White space whose pre-tokens aren't simply: a lone newline, and a space with the word after it.
_IRREGULAR = rf"{_BLANK}[\n ]|[\n ]{_BLANK}|\n\n\n|\n\n\z"


class Ragged:
    """Arrays of ids, end to end."""

    def __init__(self, dtype: str):
        self.ids = np.zeros(1 << 16, dtype)
        self.ends = np.zeros(1 << 14, np.int64)
        self.rows = 0

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[self.rows])
        self.ids = self._room(self.ids, used + len(ids))
        self.ends = self._room(self.ends, self.rows + 1 + len(lengths))
        self.ids[used : used + len(ids)] = ids
        self.ends[self.rows + 1 : self.rows + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.rows += len(lengths)

    @staticmethod
    def _room(held: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(held):
            return held
        grown = np.zeros(max(needed, 2 * len(held)), held.dtype)
        grown[: len(held)] = held
        return grown

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after another, and the length of each."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], lengths


class Encoder:
    """Ids by the tokenizers library, which sees each distinct word once while it is remembered.

    Byte-level pre-tokens never go on over a space that follows other than
    white space, nor over one or two newlines between words, so a text may be
    cut before each of those, and its ids are those of its words. A word stands
    for itself with a space before it or, where it starts with a newline, for
    itself. For a tokenizer of another kind, whole texts go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        specials = [t for t in spec["added_tokens"] if t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        self.by_word = bool(
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None
            and spec["post_processor"] is None and len(specials) == len(spec["added_tokens"])
            and not any(any(c.isspace() for c in t["content"]) for t in specials)
        )
        #: what makes a word one that the library must see by itself: white space, and special strings
        self._odd = "|".join([r"^\n?$", r"[^\n]\n|\n\n", _BLANK, *(re.escape(t["content"]) for t in specials)])
        # a special string ends what stands before it, as the end of the text does
        self._irregular = "|".join([_IRREGULAR, *("\n\n" + re.escape(t["content"]) for t in specials)])
        texts = {k: t for t, k in self.tokenizer.get_vocab().items()}
        self.starts_word = np.array([texts.get(k, "").startswith(("\u0120", "\u010a")) for k in range(max(texts) + 1)])
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._forget()

    _held: dict[str, Encoder] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder per worker process, so that tasks after the first know its words."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    _cut = re.compile(r"(?<!\s) (?!\n)")

    def _forget(self) -> None:
        #: rows of ``table`` by word
        self.known: dict[str, int] = {}
        self.table = Ragged(self.dtype)

    def _learn(self, words: pa.Array) -> None:
        """Enters the ids of words.

        Words without further white space are joined; in their ids, a token
        that starts with a space or newline starts a word.
        """
        odd = pc.match_substring_regex(words, self._odd)
        plain, apart = words.filter(pc.invert(odd)).to_pylist(), words.filter(odd).to_pylist()
        groups = [(" " + " ".join(plain[i : i + CALL_WORDS])).replace(" \n", "\n") for i in range(0, len(plain), CALL_WORDS)]
        ids = np.concatenate([np.zeros(0, self.dtype), *self._ids(groups)])
        cuts = np.flatnonzero(self.starts_word[ids])
        if len(cuts) != len(plain):
            raise ValueError("not every word has one token that starts it")
        own = self._ids([w if w.startswith("\n") else " " + w for w in apart])
        self.known.update(zip(plain + apart, range(self.table.rows, self.table.rows + len(words)), strict=True))
        self.table.extend(np.concatenate([ids, *own]), np.concatenate([np.diff(np.r_[cuts, len(ids)]), np.array([*map(len, own)], np.int64)]))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        if not self.by_word:
            return [x.tobytes() for x in self._ids(texts)]
        if not texts:
            return []
        if len(self.known) > REMEMBERED:
            self._forget()
        column = pa.array(texts, pa.large_string())
        irregular = pc.match_substring_regex(column, self._irregular).to_pylist()
        if any(irregular):
            cut = pa.array([self._cut.split(t) if odd else t.replace("\n", " \n").split(" ") for t, odd in zip(texts, irregular, strict=True)], pa.large_list(pa.large_string()))
        else:
            cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        words = cut.flatten()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        places = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            self._learn(coded.dictionary.take(pa.array(missing)))
            places[missing] = np.fromiter((self.known[distinct[k]] for k in missing.tolist()), np.int64, len(missing))
        codes = coded.indices.to_numpy()
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # a text's first word follows no space: its ids stand in a table of their own
        firsts = words.take(pa.array(starts[:-1])).to_pylist()
        return [b"".join([head, *rest]) for head, rest in zip(self._ids(firsts), self._gathered(places, codes, starts), strict=True)]

    def _gathered(self, places: np.ndarray, codes: np.ndarray, starts: np.ndarray):
        """The packed ids of each text without its first word, in parts."""
        text = 0
        while text < len(starts) - 1:
            # texts whose words fit together; a longer one goes by itself, in parts
            upto = max(text + 1, int(np.searchsorted(starts, starts[text] + GATHER_WORDS, "right")) - 1)
            if upto == text + 1:
                rows = places[codes[starts[text] + 1 : starts[upto]]]
                yield [self.table.gather(rows[k : k + GATHER_WORDS])[0].tobytes() for k in range(0, len(rows), GATHER_WORDS)]
            else:
                ids, lengths = self.table.gather(places[codes[starts[text] : starts[upto]]])
                ends = np.r_[0, np.cumsum(lengths)]
                first = starts[text:upto] - starts[text]
                for a, b in zip(ends[first + 1].tolist(), ends[starts[text + 1 : upto + 1] - starts[text]].tolist(), strict=True):
                    yield [ids[a:b].tobytes()]
            text = upto


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes each whole text, appends ``end_id``, and writes shards in ascending id order.

    Returns the manifest, already computed: shard, path, docs, tokens and
    start, the tokens in all shards before. Documents are dealt by ranges of
    id, with a hash of the text and the row's place where ids tie, so that many
    equal ids make no large shard. Ids are integers of at most 64 bits; others
    are an error. Null ids come first. Null and empty texts have the end id
    alone. ``folder`` is shared; a task that runs twice writes
    two files, and the manifest names one. An empty table has no shards.
    """
    if not isinstance(docs.select(id_col).schema[0].dataType, T.IntegralType | T.NullType):
        raise TypeError(f"{id_col} isn't an integer column")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("rid")]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        encoder = Encoder.shared(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{task.partitionId():07d}-{task.taskAttemptId()}.sst"
        writer = out = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto = at
                size = 0
                while upto < len(texts) and size < CHUNK_CHARS:
                    size += len(texts[upto])
                    upto += 1
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path)
                    writer = Writer(out, len(end))
                for key, value in zip(ids[at:upto], encoder.encode(texts[at:upto]), strict=True):
                    writer.add(id_key(key), value + end)
                at = upto
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "docs": [writer.entries], "tokens": [writer.weight]})

    shards = written(rows.mapInArrow(run, "shard long, path string, docs long, tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files.

    The CRC-32 is over the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    reader = Reader(file, file.size())
                    rows: list[tuple] = []
                    for key, value in reader.scan():
                        ids = np.frombuffer(value, f"<u{reader.width}")
                        rows.append((key_id(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _records(rows)
                            rows = []
                    if rows:
                        yield _records(rows)

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup_tokens(manifest: DataFrame, folder: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for, by binary search in each shard whose Bloom filter may have them."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    reader = Reader(file, file.size())
                    found = [(i, np.frombuffer(v, f"<u{reader.width}").tolist()) for i in ids for v in reader.get(id_key(i))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, ids array<long>")
