"""Fill-in-middle: texts are cut by rank and select over packed bit vectors of character starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of

#: The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text whose bits are packed at once; a longer text is packed by itself.
SLICE_BYTES = 8 << 20
WORD_BITS, BLOCK_BITS = 64, 512
BLOCK_WORDS = BLOCK_BITS // WORD_BITS


class Boundaries:
    """The bytes of UTF-8 that start a code point, as a packed bit vector with the ones before each block."""

    def __init__(self, data: np.ndarray) -> None:
        # bytes 10xxxxxx go on with a code point
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = len(data) // BLOCK_BITS + 1
        self.words = np.zeros(blocks * BLOCK_WORDS, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.bitwise_count(self.words).reshape(blocks, BLOCK_WORDS).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(axis=1))])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each of the byte places ``at``."""
        block, word, bit = at // BLOCK_BITS, at // WORD_BITS, (at % WORD_BITS).astype(np.uint64)
        inside = np.where(np.arange(BLOCK_WORDS) < (word % BLOCK_WORDS)[:, None], self.counts[block], 0).sum(axis=1)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + inside + np.bitwise_count(low)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the one that has ``rank`` ones before it; beyond the last, the end."""
        real = rank < self.before[-1]
        wanted = np.where(real, rank, 0)
        block = np.searchsorted(self.before, wanted, side="right") - 1
        block = np.minimum(block, len(self.counts) - 1)
        left = wanted - self.before[block]
        upto = np.cumsum(self.counts[block], axis=1)
        word = (upto <= left[:, None]).sum(axis=1).clip(max=BLOCK_WORDS - 1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.unpackbits(self.words[block * BLOCK_WORDS + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        place = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return np.where(real, block * BLOCK_BITS + word * WORD_BITS + place, self.size)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``SLICE_BYTES`` of text, or of one row."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to
        at = to


def _cut(texts: pa.Array, forms: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(from, to, [n, prefix_chars, middle_chars, output]) for slices of the rows."""
    texts = texts.cast(pa.large_binary())
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer or b"", np.uint8)
    for at, to in _slices(offsets):
        first = offsets[at]
        body = data[first : offsets[to]]
        bounds = Boundaries(body)
        ends = offsets[at : to + 1] - first
        ranks = bounds.rank(ends)
        n = np.diff(ranks)
        one, two = h1[at:to] % (n + 1), h2[at:to] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        # a cut at a text's end is where the next one starts, whose first byte is a start
        from_, upto = bounds.select(ranks[:-1] + low), bounds.select(ranks[:-1] + high)
        raw = memoryview(body)
        out = []
        for k in range(to - at):
            a, b, c, d = int(ends[k]), int(from_[k]), int(upto[k]), int(ends[k + 1])
            if forms[at + k] == "psm":
                out.append(b"".join((b"<P>", raw[a:b], b"<S>", raw[c:d], b"<M>", raw[b:c])))
            elif forms[at + k] == "spm":
                out.append(b"".join((b"<S>", raw[c:d], b"<P>", raw[a:b], b"<M>", raw[b:c])))
            else:
                out.append(bytes(raw[a:d]))
        plain = forms[at:to] == "plain"
        columns = [pa.array(n, pa.int64()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        yield at, to, columns


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Moves the middle of each whole text to its end, behind marks: no shuffle, a row per input row.

    Columns: ``doc_id``, ``n`` (code points), ``form``, ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``. The cuts and the form come
    from the SHA-256 of seed and id, so reruns agree; a null id counts as an
    empty string, and rows of one id are cut by one pair of hashes. The form is
    "plain", the text as it is, for empty and null texts, for texts that hold a
    mark, and for ``plain_percent`` of the others; of the rest
    ``spm_percent`` give the suffix first ("spm"), the others the prefix
    ("psm"). Texts of any length are cut whole. An empty table gives an empty
    result; other columns, whatever their names, aren't read.

    A batch's bytes are packed as a vector of character starts: the ones in a text
    are its length, and selecting two of them gives the byte places of the cuts.
    """
    text = text_of(text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text_of(id_col)), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), h[2].alias("h3"), h[3].alias("h4"))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    rows = rows.select("doc_id", "text", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"), "h1", "h2")

    def run(batches):
        for batch in batches:
            forms = np.array(batch.column(2).to_pylist(), object)
            h1, h2 = (batch.column(k).to_numpy() for k in (3, 4))
            for at, to, columns in _cut(batch.column(1), forms, h1, h2):
                ids, form = (batch.column(k).slice(at, to - at) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, columns[0], form, *columns[1:]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of ``fill_middle`` was made of.

    No text that isn't plain holds a mark, so that the marks part the output
    in three whatever stands beside them.
    """
    parts = lambda marks: F.split(F.substring(output, 4, 2**31 - 1), marks, -1)
    psm, spm = parts(f"{SUFFIX}|{MIDDLE}"), parts(f"{PREFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
