"""Each operator against brute force, on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import exact_dedup as ED
from quire.llm import licenses as LI
from quire.llm import mixing as MX
from quire.llm import near_dedup as ND
from quire.llm import packing as PK
from quire.llm import pii as PI
from quire.llm import quality as QU
from quire.llm import sstable as SS
from quire.llm import token_counts as TC
from quire.llm import token_files as TF
from quire.llm import toxicity as TX
from quire.llm.common import new_path
from quire.llm.quotient import CountingQuotientFilter

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside.
CLASH = "fp long, norm string, rid long, key string, h long, kept boolean, node long, size int, words string"
#: Names that they give to columns beside those of a table, and one with a dot.
CLASH += ", _sha string, _gone_id string, _fp string, __FP string, _tied int, `a.b` int"


def odd_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "The", "of", "und", "la", "x1", "é", "🙂", "a.b@c.de", "+49 (30) 1234567", "4111 1111 1111 1111", "10.0.0.255", "300.1.1.1"]
    body = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    body += [b.replace(" ", "\n", 3) for b in body[:6]] + [b.upper() for b in body[:3]]
    long_text = " ".join(f"w{rng.randint(0, 4000)}" for _ in range(30_000))
    return [None, "", " ", "\n\t", "one", "one", *body, *body[:5], long_text, long_text + " tail", "a" * 20_000, "1 2 " * 9000, "<|endoftext|> x", "  two  spaces\n\n\nlines \n"]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    out = [(k, t, f"s{k % 4}" if k % 7 else None) for k, t in enumerate(texts)]
    return out + [(3, "repeated row", "s1")] * 3 + [(None, "no id", "s1"), (None, "no id", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [None, "n", 1, "k", 2, True, 3, 4, "w", "x", "y", "z", None, 5, 6]
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def by_row(got, rows, *columns):
    """Results and rows as multisets by id."""
    return Counter(tuple(r[c] for c in columns) for r in got)


def test_empty_tables(spark, empty):
    assert ED.exact_dedup(empty).count() == ND.near_dedup(empty).count() == PI.find_pii(empty).count() == QU.quality_rules(empty).count() == 0
    assert MX.mix_sources(empty).count() == PK.pack_documents(empty).count() == TC.count_tokens(empty, PIECES).count() == 0
    assert LI.scan_licenses(empty, LI.document_path(empty)).count() == 0
    folder = new_path(spark, "none")
    assert TF.read_token_shards(TF.write_token_shards(empty, folder, BPE), folder).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert TX.score_toxicity(empty, TX.learn_lexicon(empty, labels)).count() == 0


# --- 1


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(0, 40), max_size=60))
def test_filters_merge_without_loss(a, b):
    spread = lambda x: np.array([v * 0x9E3779B97F4A7C15 % (1 << 64) for v in x], np.uint64)
    merged = CountingQuotientFilter.build(spread(a), 6).merge(CountingQuotientFilter.build(spread(b), 6))
    want = Counter(spread(a + b).tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == want
    assert all(merged.count(k) == n for k, n in want.items()) and merged.count(12345) == 0
    many = CountingQuotientFilter.build(spread(a), 6).merge(*[CountingQuotientFilter.build(spread([x]), 6) for x in b])
    assert (many.fingerprints() == merged.fingerprints()).all() and (many.counts == merged.counts).all()
    parts = list(merged.segments(4))
    assert sum(len(p[1]) for p in parts) == len(want) and [p[0] for p in parts] == sorted({k >> 60 for k in want})


def test_exact_dedup(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = ED.exact_dedup(docs).collect()
    assert by_row(got, rows, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = ED.keep_first(docs)
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in left.collect())
    assert left.columns == docs.columns and Counter(norm(r["text"]) for r in left.collect()) == Counter(groups.keys())


# --- 2


def test_best_fit_is_tightest():
    pieces = [(5, "a", 1), (4, "b", 2), (3, "c", 1), (3, "d", 2), (1, "a", 1)]
    assert PK.pack(pieces, 8, 4) == [(0, 0), (1, 0), (1, 4), (0, 5), (2, 0)]
    assert PK.pack([(1, "a", k) for k in range(5)], 8, 2) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10), st.integers(0, 2), st.integers(0, 4)), max_size=60))
def test_packing_matches_plain_search(pieces):
    bins = []
    want = []
    for size, source, cluster in pieces:
        free = lambda b: (not size or cluster not in b["clusters"]) and b["sources"][source] < 3
        fit = [(10 - b["used"], k) for k, b in enumerate(bins) if 10 - b["used"] >= size and b["used"] < 10 and free(b)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"used": 0, "clusters": set(), "sources": Counter()})
        want.append((k, bins[k]["used"]))
        bins[k]["used"] += size
        if size:
            bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
    assert PK.pack(pieces, 10, 3) == want


def test_packed_documents(docs, rows):
    got = PK.pack_documents(docs, capacity=100, per_source=2).collect()
    by_bin, by_doc = defaultdict(list), Counter()
    for r in got:
        by_bin[r["bin_id"]].append(r)
        by_doc[r["doc_id"]] += r["length"]
    sizes = Counter()
    for i, t, _ in rows:
        sizes[i] += len(WORD.findall(t or ""))
    assert by_doc == sizes
    for parts in by_bin.values():
        parts.sort(key=lambda r: (r["bin_start"], r["length"]))
        assert sum(r["length"] for r in parts) == parts[0]["bin_used"] <= 100
        at = 0
        for r in parts:
            assert r["bin_start"] == at
            at += r["length"]
        assert max(Counter(r["source"] for r in parts).values()) <= 2
        ids = [r["doc_id"] for r in parts if r["doc_id"] == 3]
        assert len(ids) <= 2  # the row of its own text, and one of the repeated rows


def test_packing_keeps_ids_whole(spark):
    ids = [None, 2**60 + 1, 2**60 + 3, 2**60 + 5, -(2**62) - 1, None]
    d = spark.createDataFrame([(i, None if k % 2 else "s", "w " * k) for k, i in enumerate(ids)], "doc_id long, source string, text string").coalesce(1)
    assert Counter(r["doc_id"] for r in PK.pack_documents(d).collect()) == Counter(ids)


def test_empty_pieces_are_of_no_cluster(spark):
    rows = [(k, "s", None if k % 2 else " ") for k in range(40)] + [(100, "s", "a b c")]
    got = PK.pack_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), capacity=10, per_source=50).collect()
    assert len(got) == 41 and len({r["bin_id"] for r in got}) == 1 and {r["bin_used"] for r in got} == {3}


# --- 3


def test_pii(docs, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    want = Counter()
    for i, t, _ in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        want[(i, ",".join(spans))] += 1
    got = PI.find_pii(docs).select("doc_id", PI.span_list(list(patterns)).alias("spans")).collect()
    assert Counter((r["doc_id"], r["spans"]) for r in got) == want


def test_pii_edges(spark):
    texts = [
        "a@b.c_x@d.e", "x" * 50_000 + " 1.2.3.4.5.6.7.8", "IBAN DE89 3704 0044 0532 0130 00 end", "DE88370400440532013000", "ssn: 123-45-6789", "no 123-45-6789",
        "9" * 3000, "+1-2-3" * 3000, "a." * 4000 + "@x.y", "4111-1111-1111-1111x",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in PI.find_pii(d).collect()}
    assert [s["match"] for s in got[0]["email"]] == ["a@b.c", "_x@d.e"]
    assert [s["match"] for s in got[1]["ip"]] == ["1.2.3.4", "5.6.7.8"]
    assert got[2]["iban"][0]["match"] == "DE89 3704 0044 0532 0130 00" and not got[3]["iban"]
    assert got[4]["ssn"] and not got[5]["ssn"] and got[9]["card"]
    masked = d.join(PI.find_pii(d), "doc_id").filter("doc_id = 0").select(PI.mask(F.col("text"), F.col("email"))).first()[0]
    assert masked == "*" * 11


def test_ibans_before_upper_case_words(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"]
    after = ["", " BIC: COBADEFF", " BIC COBADEFFXXX", " EUR 250", " AND MORE", " 12 34", ". X", ", DE"]
    texts = [(f"IBAN: {n}{a}", [n]) for n in numbers for a in after]
    texts += [(" ".join(numbers), numbers), ("ZZ12 KONTO IBAN " + numbers[1] + " EUR", [numbers[1]]), (numbers[0] + "X", []), (numbers[0][:-1], []), ("DE88370400440532013000 BIC", [])]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in PI.find_pii(d).collect():
        text, want = texts[r["doc_id"]]
        assert [s["match"] for s in r["iban"]] == want, text
        assert all(text[s["start"] : s["end"]] == s["match"] for s in r["iban"])



# --- 4


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(1 << 62), 1 << 62)), st.binary(max_size=40)), max_size=120))
def test_shards_come_back(items):
    import io

    items = sorted(((SS.id_key(k), v) for k, v in items), key=lambda x: x[0])
    out = io.BytesIO()
    writer = SS.Writer(out, 1, block_bytes=200)
    for k, v in items:
        writer.add(k, v)
    writer.close()
    reader = SS.Reader(out, out.tell())
    assert list(reader.scan()) == items and reader.entries == len(items)
    for k, _ in items:
        assert reader.get(k) == [v for o, v in items if o == k]
    assert reader.get(SS.id_key(7_777_777_777)) == [v for o, v in items if o == SS.id_key(7_777_777_777)]
    assert all(SS.key_id(SS.id_key(x)) == x for x in (None, -5, 0, 9))


def test_token_files(spark, docs, rows):
    folder = new_path(spark, "shards")
    manifest = TF.write_token_shards(docs, folder, BPE)
    got = TF.read_token_shards(manifest, folder).collect()
    encoder = TF.Encoder(BPE)
    ids = {t: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in rows}
    want = Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    found = {r["doc_id"]: r["ids"] for r in TF.lookup_tokens(manifest, folder, [4, 999]).collect()}
    assert found == {4: ids["one"]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "\n", "\t", "é", "日", "'s", "12", "<|endoftext|>", "\n\n<|endoftext|>", ".", "\xa0", "\x1e", "\r", "Ġ", "Ċ", "_"]), max_size=25).map("".join), max_size=8))
def test_encoder_is_the_library(texts):
    encoder = TF.Encoder.shared(BPE)
    want = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


# --- 5


def plain_components(rows, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return sets, [find(k) for k in range(len(rows))]


def check_near(got, rows, percent):
    sets, root = plain_components(rows, percent)
    low = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = Counter((rows[k][0], len(sets[k]), low[root[k]] if sets[k] else rows[k][0]) for k in range(len(rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))


def test_near_dedup(docs, rows):
    check_near(ND.near_dedup(docs, threshold=0.85).collect(), rows, 85)
    left = ND.keep_one(docs, threshold=0.85)
    whole = {tuple(r) for r in docs.collect()}
    assert left.columns == docs.columns and all(tuple(r) in whole for r in left.collect())


def test_near_dedup_of_a_large_group(spark):
    """Copies with few and many edits: some link to the base alone, some to nothing, some in chains."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(140)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6])):
            at = rng.randrange(len(words))
            words[at] = f"e{rng.randint(0, 60)}"
            if rng.random() < 0.2:
                del words[rng.randrange(len(words))]
        rows.append((1000 - k, " ".join(words), "s"))
    chain = [f"c{k}" for k in range(130)]
    for k in range(30):
        rows.append((2000 + k, " ".join(chain[k:] + [f"d{j}" for j in range(k)]), "s"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_near(ND.near_dedup(d, threshold=0.85).collect(), rows, 85)


def test_near_dedup_of_templated_pages(spark, monkeypatch):
    """Pages with words in common that keys can't tell from copies, some of them linked, in blocks of few nodes."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(90):
        own = [f"u{rng.randint(0, 10**6)}" for _ in range(28)]
        rows.append((k, " ".join(base + own), "s"))
        if k % 6 == 0:
            rows.append((500 + k, " ".join(base + own[:-1] + ["other"]), "s"))
            rows.append((700 + k, " ".join([*base[: rng.randint(60, 120)], *own]), "s"))
    monkeypatch.setattr(ND, "BLOCK_NODES", 7)
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_near(ND.near_dedup(d, threshold=0.85).collect(), rows, 85)
    check_near(ND.near_dedup(d, threshold=0.7).collect(), rows, 70)


def test_near_dedup_of_one_long_text(spark):
    """A batch that ends just where its shingles were worked off."""
    rows = [(1, " ".join(f"w{k}" for k in range(ND.TOGETHER + 10)), "s")]
    check_near(ND.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), threshold=0.85).collect(), rows, 85)


def test_keep_one_tells_rows_apart(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f "), (2, "other words stand here now"), (3, "p q"), (3, "p q"), (4, ""), (4, "")]
    left = ND.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, left.collect())) == [(1, "a b c d e f"), (2, "other words stand here now"), (3, "p q"), (4, ""), (4, "")]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r["node"]: r["root"] for r in ND.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((90, 95, 100), 90)


# --- 6


def test_toxic_grammar():
    lexicon = TX.Lexicon()
    score = TX.Scorer(lexicon).score
    plain, negated, reported, threat = score("you are an idiot"), score("you are not an idiot"), score("he said you are an idiot"), score("I will kill you")
    assert plain > negated > score("you are a friend") and plain > reported
    assert threat > 0.3 > score("I will kill the process")
    assert 0 <= score("") < 0.3 and TX.Scorer(lexicon).evidence("clean words only") == 0


_VOCABULARY = ["idiot", "zorgan", "zorga", "zorgx", "zor", "kill", "hurt", "will", "shall", "you", "they", "not", "never", "said", "wrote", "stone", "river", "killing"]


def plain_clause(words, stems):
    """The same by looking back from each insult and threat."""

    def weight(w):
        found = [stems[w[:k]] for k in range(len(w), 0, -1) if w[:k] in stems]
        own = TX.INSULT_WEIGHT if w in TX.INSULTS else 0.0
        return max(found[0], own) if found else own

    insult = [weight(w) > 0 for w in words]
    of = lambda k, group: words[k] in group and not insult[k]
    targeted = any(of(k, TX.TARGETS) for k in range(len(words)))
    total = 0.0
    for k, w in enumerate(words):
        if insult[k]:
            x = weight(w)
        elif of(k, TX.THREATS) and targeted and any(of(j, TX.MODALS) for j in range(max(0, k - 4), k)):
            x = TX.THREAT_WEIGHT
        else:
            continue
        x *= TX.TARGETED if targeted else 1
        x *= TX.NEGATED if any(of(j, TX.NEGATIONS) for j in range(max(0, k - 3), k)) else 1
        x *= TX.REPORTED if any(of(j, TX.REPORTS) for j in range(k)) else 1
        total += x
    return total


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_VOCABULARY), max_size=14))
def test_grammar_matches_plain_search(words):
    stems = {"zor": 2.0, "zorga": 3.5, "stone": 1.0}
    scorer = TX.Scorer(TX.Lexicon(stems))
    assert abs(scorer.clause(words) - plain_clause(words, stems)) < 1e-9
    assert abs(scorer.evidence(" ".join(words)) - plain_clause(words, stems)) < 1e-9


def test_toxicity_of_odd_rows(spark, docs, rows):
    got = TX.score_toxicity(docs, TX.Lexicon()).collect()
    scorer = TX.Scorer(TX.Lexicon())
    want = Counter((i, scorer.score(t or "")) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["score"]) for r in got) == want
    left = TX.keep_civil(docs, TX.Lexicon())
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])


def test_learned_words(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 8 == 0
        words = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        if toxic:
            words[5:5] = [f"zorg{rng.choice('abc')}", f"zorg{rng.choice('xyz')}"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = TX.learn_lexicon(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    assert any(s.startswith("zor") for s in lexicon.stems)
    got = {r["doc_id"]: r for r in TX.score_toxicity(docs, lexicon).collect()}
    held = [k for k in range(400) if TX.held_out(k)]
    assert all(got[k]["predicted"] == labels[k][1] for k in held) and got[900]["predicted"] == 0
    left = {r["doc_id"] for r in TX.keep_civil(docs, lexicon).collect()}
    assert left == {k for k, r in got.items() if not r["predicted"]}


# --- 7


def test_quality(docs, rows):
    want = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = QU.quality_rules(docs).collect()
    assert by_row(got, rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_rules_name_what_fails(spark):
    clean = " ".join(f"the word{k} of text{k}" for k in range(30))
    d = spark.createDataFrame([(1, clean), (2, clean.replace(" ", "### ")), (3, clean.upper()), (4, clean.replace("the", "zz").replace("of", "yy"))], "doc_id long, text string")
    failed = {r["doc_id"]: r["failed"] for r in QU.quality_rules(d).collect()}
    assert failed[1] == [] and "symbols" in failed[2] and "upper_case" in failed[3] and failed[4] == ["stop_words"]


# --- 8


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        ("a/b/x.py", "code"), ("a/b/y.py", "text\nLicensed under the Apache License, Version 2.0.\nmore"), ("a/b/c/z.py", None), ("d/q.py", ""), ("top.py", "no licence words here"),
        ("e/one", "Licensed under CC BY-NC 4.0."), ("e/two", "This work is licensed under the GNU General Public License, version 3."), ("e/three", "x"), (None, "Released under the MIT License."),
    ]
    d = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)] + [(1, "a/b/x.py", "code")], "doc_id long, path string, text string")
    got = LI.scan_licenses(d, F.col("path")).collect()
    assert len(got) == len(rows) + 1
    by = {r["path"]: (r["license"], r["how"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "own") and by["a/b/y.py"] == ("Apache-2.0", "own") and by[None] == ("MIT", "own")
    assert by["a/b/x.py"] == ("Apache-2.0", "inherited") and by["a/b/c/z.py"] == ("Apache-2.0", "inherited")
    assert by["d/q.py"] == by["top.py"] == (None, None)
    assert by["e/one"][0] == "CC-BY-NC-4.0" and by["e/two"][0] == "GPL-3.0" and by["e/three"] == (None, None)


def test_wrapped_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    free = (
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    )
    rest = (
        "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n"
        "GNU {0}General Public License for more details.\n\nYou should have received a copy of the GNU {0}General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."
    )
    marked = lambda t, m: "\n".join(f"{m} {x}".rstrip() for x in t.split("\n"))
    notices = {"MPL-2.0": mpl} | {f"{k}GPL-3.0": (free + rest).format(w) for k, w in (("", ""), ("L", "Lesser "), ("A", "Affero "))}
    for name, word, version in (("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser ", "2.1")):
        notices[name] = (free + rest).format(word).replace("version 3", f"version {version}")
    library = notices["LGPL-3.0"].replace("program", "library")
    notices["Unlicense"] = "This is free and unencumbered software released into the public\ndomain."
    rows = []
    for name, t in notices.items():
        glued = t.replace("\n\n", "\n")
        forms = [t, marked(t, "#") + "\nimport os\nx = 1", "/*\n" + marked(t, " *") + "\n */\nint main() { return 0; }", marked(t, "//") + "\n\ncode", "code = 1\n" + marked(glued, "#"), t.replace("\n", "\r\n"), glued]
        rows += [(f"{name}/{k}/x", f, name) for k, f in enumerate(forms)]
    body = (LI._MIT.replace(", ", ",\n")).replace(": The", ":\n\nThe").replace(". THE", ".\n\nTHE")
    rows.append(("whole/LICENSE", f"MIT License\n\nCopyright (c) 2020 A Person\n\n{body}\n", "MIT"))
    rows.append(("library/x", library, "LGPL-3.0"))
    rows.append(("prose/x", "Words of a software that is free\nwere printed in public, and no\ndomain of the house was sold.", None))
    d = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: r["license"] for r in LI.scan_licenses(d, F.col("path")).collect()}
    assert got == {p: name for p, _, name in rows}



def test_notices_inside_longer_lines(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    words = " ".join(f"word{k}" for k in range(450))
    rows = [
        (f"Copyright 2020 Foo. {notice} All rights reserved by the authors of this and of other works", "Apache-2.0"),
        (f"{words} {notice} {words}", "Apache-2.0"), (f"{words} {words}", None), (f"{words} copyright {words}", None),
        (f"{words}\nmore of it. Released under the\nMIT License. And {words}", "MIT"),
        (f"{words} This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License {words}", "GPL-3.0"),
        ("We say nothing of copyright here, and nobody is licensed to drive", None),
    ]
    d = spark.createDataFrame([(k, f"p{k}/x", t) for k, (t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in LI.scan_licenses(d, F.col("path")).collect()}
    assert got == {k: name for k, (_, name) in enumerate(rows)}


def plain_licenses(rows):
    """(path, license, how) by comparing every unit of a text with every template."""
    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
    templates = [(name, words(t)) for name, t in LI.TEMPLATES]
    n = len(templates)
    df = Counter(w for _, t in templates for w in t)
    idf = lambda w: np.log((1 + n) / (1 + df[w])) + 1
    vector = lambda t: {w: k * idf(w) for w, k in t.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vector(t)) for name, t in templates]

    def best(unit):
        v = vector(words(unit))
        scores = [(round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6), -k, name) for k, (name, t) in enumerate(vectors)] if v else []
        return max([s for s in scores if s[0] >= LI.LEAST], default=None)

    def units(path, text):
        yield from ((0, k, x) for k, x in enumerate(y for y in re.split(r"[\n\r]", text) if re.search(LI.MARK, y)))
        parted = re.sub(LI._EDGE, lambda m: (m[1] or "") + (m[2] or "") + "\n\n", re.sub(LI._EMPTY, "", re.sub(r"\r\n?", "\n", text)))
        every = [x for x in re.split(r"\n\n+", parted) if re.search(LI.BLOCK_MARK, x)]
        yield from ((1, k, x) for k, x in enumerate(y for y in every if "\n" in y))
        if path is not None and re.search(LI.LICENSE_FILE, path):
            yield 2, 0, text
        for x in every:
            t = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", x.lower())
            for w in LI.WINDOWS:
                if len(t) > w:
                    yield from ((3, 0, y) for y in (" ".join(t[k : k + w]) for k in range(0, len(t), w // 4)) if re.search(LI.TERM_MARK, y))

    own = {}
    for path, text in rows:
        found = [(b[0], -part, -no, b[2]) for part, no, x in units(path, text or "") if (b := best(x))]
        if found:
            own[path] = (max(found)[0], max(found)[3])
    above = lambda p: [p[:k] for k in range(len(p)) if p[k] == "/"][::-1] + [""]
    dirs = defaultdict(list)
    for path, (score, name) in own.items():
        if path is not None:
            dirs[above(path)[0]].append((path, score, name))
    stated = {}
    for d, files in dirs.items():
        named = [(-score, path, name) for path, score, name in files if re.search(LI.LICENSE_FILE, path)]
        if named or len({f[2] for f in files}) == 1:
            stated[d] = min(named)[2] if named else files[0][2]
    for path, _ in rows:
        inherited = next((stated[d] for d in above(path) if d in stated), None) if path is not None else None
        yield path, own[path][1] if path in own else inherited, "own" if path in own else "inherited" if inherited else None


def test_licenses_match_plain_search(spark):
    rng = random.Random(6)
    notices = [t for _, t in LI.TEMPLATES]
    rows = [("LICENSE", notices[0] * 3), ("a/b/COPYING", notices[5]), ("long/x.txt", "w " * 30_000 + notices[1] + " w" * 9000), ("tie/one", f"{notices[0]}\n{notices[4]}"), ("tie/two", f"{notices[4]}\n{notices[0]}")]
    for k in range(60):
        place = "/".join([*rng.choices("abc", k=rng.randint(0, 3)), f"f{k}"])
        some = [" ".join(rng.choices(["alpha", "licensed", "the", "of", "under", "copyright", "free", "software"], k=rng.randint(1, 30))) for _ in range(3)]
        if rng.random() < 0.4:
            t = rng.choice(notices)
            some.insert(rng.randint(0, 3), t if rng.random() < 0.5 else "\n".join(f"# {x}" for x in re.findall(r"(?:\S+\s*){1,7}", t)))
        rows.append((place, rng.choice(["\n", "\n\n", " "]).join(some) if rng.random() < 0.8 else None))
    d = spark.createDataFrame([(k, p, t, "x", 1) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string, tf int").repartition(3)
    got = {r["path"]: (r["license"], r["how"]) for r in LI.scan_licenses(d, F.col("path")).collect()}
    assert got == {p: (name, how) for p, name, how in plain_licenses(rows)}


# --- 9


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mixing(spark, docs, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = plain_targets(sizes)
    got = MX.mix_sources(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(WORD.findall(t or "")), sizes[s]) for i, t, s in rows)
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"]) and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(sizes.values()) + 1e-6
    again = MX.mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def plain_mix(rows, hashes):
    """The copies of each row by queueing one document after another."""
    sizes, docs = defaultdict(int), defaultdict(list)
    for k, (_, t, s) in enumerate(rows):
        sizes[s] += len(WORD.findall(t or ""))
        docs[s].append(k)
    target = plain_targets(sizes)
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    queue = []
    for s, own in docs.items():
        end = 0
        order = sorted(own, key=lambda k: hashes[k] % (1 << 64))  # blocks are in order of unsigned hashes
        for epoch in range(2):
            for k in order:
                end += size[k]
                if size[k] and target[s]:
                    queue.append((end / target[s], "n" if s is None else f"s{s}", hashes[k], epoch, k))
    budget, used, copies = sum(target.values()), 0, Counter()
    for *_, k in sorted(queue):
        used += size[k]
        if used > budget * (1 + 1e-12):
            break
        copies[k] += 1
    return [copies[k] for k in range(len(rows))]


def test_mixing_matches_plain_queue(spark):
    rng = random.Random(14)
    rows = [(k if k % 9 else None, " ".join(["w"] * rng.randint(0, 12) + [str(k)]), rng.choice(["a", "b", "b", "b", "b", "c", "dd", None])) for k in range(700)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string, source string")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    hashed = d.select("k", F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), key, F.xxhash64("text")).alias("h")).collect()
    hashes = {r["k"]: r["h"] for r in hashed}
    want = plain_mix(rows, hashes)
    got = MX.mix_sources(d.repartition(3)).collect()
    size = [len(WORD.findall(t)) for _, t, _ in rows]
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == Counter((i, s, size[k], want[k]) for k, (i, _, s) in enumerate(rows))


def test_mixing_nears_targets(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c"]), " x" * rng.randint(1, 9)) for k in range(4000)]
    got = MX.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)


# --- 10


def test_token_counts(docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in rows)
    assert by_row(TC.count_tokens(docs, PIECES).collect(), rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


COUNTER = []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*"aehinot b\n\tz▁é日🙂\0", "the", "<s>", "ing", "  ", "1990"]), max_size=300).map("".join))
def test_counts_are_the_librarys(text):
    import sentencepiece

    if not COUNTER:
        COUNTER.extend([TC.TokenCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)])
    counter, library = COUNTER
    assert counter.count([text]) == [len(library.encode(text))]
    token = "▁" + text.replace(" ", "▁")
    assert counter.ranks.counts([token, ""]).tolist() == ([len(library.encode(text)), 0] if text else [1, 0])


def test_counts_of_long_runs():
    """Pre-tokens of thousands of characters: one letter, few letters, any letters, words without spaces, and digits."""
    import sentencepiece

    rng = random.Random(12)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = [library.id_to_piece(k).strip("▁") for k in range(300, 8000, 7)]
    texts = ["a" * 30_001, "=" * 5000, "".join(rng.choices("ab", k=4000)), "".join(rng.choices("ACGT", k=20_000)), "".join(rng.choices(words, k=6000)), "0123456789" * 900]
    texts += ["".join(rng.choices([chr(c) for c in range(33, 127)], k=20_000)), "日本語のテキスト" * 700, "thethethethe" * 1500, "_-" * 4000 + "é" * 3000, "short"]
    assert TC.TokenCounter(PIECES).count(texts) == [len(library.encode(t)) for t in texts]
