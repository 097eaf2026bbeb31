"""Repeated passages, phrases and fill-in-middle against brute force, on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import collocations as CO
from quire.llm import fill_middle as FM
from quire.llm import licenses as LI
from quire.llm import pii as PI
from quire.llm import suffix_dedup as SD
from quire.llm import toxicity as TX

#: Names that operators use inside, and one with a dot.
CLASH = "unit long, no int, body string, ends int, key string, n long, h1 long, form string, `a.b` int, lang2 string"


def rows_of():
    rng = random.Random(3)
    words = ["alpha", "beta", "of", "the", "né", "🙂", "x\x01y", "x\x00", "\x01", "zero​"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, edge = text(60), "é" * 300
    body = [text(rng.randint(1, 200)) for _ in range(12)]
    body += [b[: rng.randint(0, 200)] + passage[rng.randint(0, 20) :] + text(9) for b in body[:8]]
    body += ["a" * 3000, "ab" * 700, edge + "x" + edge, "q" + edge, body[0], body[0], body[1] + " tail", "<P> held", "a<S>b", "<<M>", "< P>"]
    out = [(k, t, "en" if k % 3 else None) for k, t in enumerate([None, "", " ", ".,;\n", *body])]
    return out + [(None, passage, "en"), (None, None, "de"), (7, "again", "de"), (7, "again", "de")]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [1, 2, "b", 3, "k", 4, 5, "f", 6, "l"]
    return spark.createDataFrame([(*r, *more) for r in rows], f"doc_id long, text string, lang string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_empty_tables(empty):
    assert SD.remove_repeats(empty).count() == CO.mine_phrases(empty).count() == FM.fill_middle(empty).count() == 0


# --- repeated passages


def removed_by_hand(texts, length):
    """(bytes, spans, kept) of each text, from every string of ``length`` bytes."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = []
        for value, run in itertools.groupby(range(len(t)), gone.__getitem__):
            run = list(run)
            spans += [(run[0], run[-1] + 1)] if value else []
        yield len(t), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize("length", [14, 40, 400])
def test_passages_are_removed(docs, rows, length, monkeypatch):
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter((r[0], n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest(), tuple(s), k) for r, (n, s, k) in zip(rows, removed_by_hand(texts, length), strict=True))
    got = SD.remove_repeats(docs, length=length, texts=True).collect()
    assert Counter((r[0], *r[1:5], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in got) == want


def test_bytes_not_words_decide(spark):
    """A passage of 51 words in two texts stays with 399 bytes and goes with 400."""
    passage = lambda size: " ".join([*(f"{size}{k:02d}" for k in range(50)), "x" * (size - 300)])
    docs = spark.createDataFrame([(10 * size + k, a + passage(size) + b) for size in (399, 400) for k, (a, b) in enumerate(("<>", "[]"))], "doc_id long, text string")
    removed = lambda length: {r["doc_id"]: r["n_removed"] for r in SD.remove_repeats(docs, length=length).collect()}
    assert removed(400) == {3990: 0, 3991: 0, 4000: 400, 4001: 400}
    assert removed(399) == {3990: 399, 3991: 399, 4000: 400, 4001: 400}


def test_cover_meets_every_shift():
    for most in (7, 20, 183, 200):
        v, places = SD.difference_cover(most)
        assert v <= most and {(a - b) % v for a in places for b in places} == set(range(v))
    with pytest.raises(ValueError, match="14"):
        SD.difference_cover(6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=12), st.integers(1, 4), st.integers(1, 5))
def test_stages_find_what_sorting_all_suffixes_does(texts, parts, blocks):
    """The stages on blocks, with the parts' answers passed by hand."""
    import pyarrow as pa

    length, finder = 14, SD.Finder(14, parts)
    encoded = [t.encode() for t in texts]
    held = [encoded[k::blocks] for k in range(blocks)]
    bodies = [(np.frombuffer(b"".join(h), np.uint8), np.cumsum([len(x) for x in h]).astype(np.int64)) for h in held]
    replies = [[None] * 3 for _ in held]
    for stage, (columns, find) in enumerate(((1, lambda b, e, r: finder.sample(b, e)[1]), (3, lambda b, e, r: finder.repeated(b, e, r[0])[1]), (2, lambda b, e, r: finder.edges(b, e, r[0], r[1])[2]))):
        entries = [x for k, (b, e) in enumerate(bodies) for x in SD._entries(k, 0, find(b, e, replies[k]))]
        for part in {x[0] for x in entries}:
            own = list(zip(*[x for x in entries if x[0] == part], strict=True))
            answered = SD._answered(columns)(pa.table(dict(zip(("part", "unit", "no", "entries"), own, strict=True))))
            for row in answered.to_pylist():
                replies[row["unit"]][stage] = [*(replies[row["unit"]][stage] or []), row]
    want = list(removed_by_hand([t for h in held for t in h], length))
    got = [t for k, (b, e) in enumerate(bodies) for t in np.split(finder.removed(b, e, *replies[k]), e[:-1])[: len(e)]]
    assert [[bool(x) for x in g] for g in got] == [[any(a <= i < b for a, b in s) for i in range(n)] for n, s, _ in want]


# --- phrases


def phrases_by_hand(rows, least, top):
    found = []
    by_lang = {}
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        by_lang.setdefault(lang or "und", []).extend([w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low))
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        found += [(lang, k + 1, p.decode(), -a, x, y, n, -s) for k, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return found


@pytest.mark.parametrize(("least", "top", "task"), [(2, 2000, 1 << 20), (5, 7, 40)])
def test_phrases_are_counted_and_ranked(docs, rows, least, top, task, monkeypatch):
    monkeypatch.setattr(CO, "TASK_ROWS", task)  # prefixes then go on over the edges of many tasks
    got = CO.mine_phrases(docs, least=least, top=top).collect()
    assert Counter(map(tuple, got)) == Counter(phrases_by_hand(rows, least, top))


def test_phrases_need_no_vocabulary_in_tasks(docs, rows, monkeypatch):
    monkeypatch.setattr(CO, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, CO.mine_phrases(docs, least=4).collect())) == Counter(phrases_by_hand(rows, 4, 2000))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"\x01", b"\x00", b"\x02c"]), min_size=2, max_size=4), max_size=30), st.integers(1, 8), st.integers(1, 4))
def test_stack_counts_all_prefixes(suffixes, batch, least):
    import pyarrow as pa

    escape = lambda w: w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    keys = sorted((b"\x00".join([b"en", *map(escape, s)]) for s in suffixes), reverse=True)
    stack = CO.PrefixStack(4, least)
    for k in range(0, len(keys), batch):
        part = keys[k : k + batch]
        stack.add(pa.array(part, pa.binary()), np.ones(len(part), np.int64))
    stack.finish()
    want = Counter(b" ".join(s[:k]).decode() for s in suffixes for k in range(1, len(s) + 1))
    got = Counter()
    for lang, phrase, _, a in stack.out:
        assert lang == "en"
        got[phrase] += a
    assert all(want[p] == a for p, a in got.items()) and {p for p, a in want.items() if a >= least} <= set(got)


# --- fill-in-middle


def filled_by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 1 << 12, 8 << 20])
def test_middles_move_and_come_back(docs, rows, size, monkeypatch):
    monkeypatch.setattr(FM, "SLICE_BYTES", size)
    out = FM.fill_middle(docs)
    got = out.select("*", FM.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(filled_by_hand(i, t) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t, _ in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=900))
def test_rank_and_select(text):
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = FM.Boundaries(data)
    starts = np.cumsum([0] + [len(c.encode()) for c in text])
    assert bounds.select(np.arange(len(text) + 1)).tolist() == starts.tolist()
    assert bounds.rank(starts).tolist() == list(range(len(text) + 1))


# --- long and odd texts in earlier operators


def test_many_matches_in_one_text(spark):
    one = spark.createDataFrame([(1, "1." * 100_000), (2, "a@b.co x " * 20_000), (3, "12 a " * 30_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in PI.find_pii(one).collect()}
    assert len(found[1]["ip"]) == 25_000 and found[1]["ip"][-1]["end"] == 199_999
    assert len(found[2]["email"]) == 20_000 and [s["start"] for s in found[2]["email"][:3]] == [0, 9, 18] and not found[3]["card"]


def test_licenses_of_very_long_terms(spark):
    files = spark.createDataFrame([(1, "a/b", "license " + "a-" * 100_000), (2, "a/c", "license " + "x" * 200_000)], "doc_id long, path string, text string")
    assert LI.scan_licenses(files, F.col("path")).filter("license is null").count() == 2


def test_beginnings_of_any_length(spark):
    long_word = "vile" * 20
    rows = [(1, long_word + x) for x in "abcd"] + [(0, "other " + "word" * 9)] * 4 + [(1, "vi"), (0, None)]
    texts = spark.createDataFrame(rows, "label int, text string").fillna("")
    got = {r["stem"]: (r["t"], r["c"]) for r in TX.beginnings(texts, 4).collect()}
    words = ["other", "word" * 9]
    want = {long_word[:k]: (4, 0) for k in range(3, len(long_word) + 1)} | {w[:k]: (0, 4) for w in words for k in range(3, len(w) + 1)}
    assert got == want


def test_toxicity_with_clashing_columns_and_long_texts(spark):
    lexicon = TX.Lexicon({"vilest": 6.0})
    docs = spark.createDataFrame([(1, "you vilest " * 50_000, 0.1, 2), (2, None, 0.2, 3)], "doc_id long, text string, score double, predicted int")
    got = {r["doc_id"]: r["predicted"] for r in TX.score_toxicity(docs, lexicon).collect()}
    assert got == {1: 1, 2: 0} and TX.keep_civil(docs, lexicon).columns == docs.columns
