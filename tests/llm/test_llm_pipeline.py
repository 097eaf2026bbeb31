import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as CP
from pyspark.sql import functions as F
from quire.llm import queries as LQ
from quire.llm.common import made_paths, table, written
from quire.llm.toxicity import Scorer, learn_lexicon
from test_llm_operators import WORD, plain_components, plain_mix

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [n for n, _ in CP.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in CP.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = [r["text"] for r in kept["toxicity"].collect()]
    second = [r["text"] for r in kept["exact_dedup"].collect()]
    assert Counter(map(norm, second)) == Counter(set(map(norm, first)))
    mixed = Counter(r["doc_id"] for r in kept["mix"].collect())
    assert set(mixed.values()) <= {1, 2}
    words = {r["doc_id"]: len(r["text"].split()) for r in kept["near_dedup"].collect()}
    packed = kept["pack"].collect()
    assert sum(r["length"] for r in packed) == sum(words[i] * n for i, n in mixed.items())
    tails = Counter((r["bin_id"], r["doc_id"]) for r in packed if r["length"])
    assert max(tails.values()) == 1


def test_odd_rows_run_through(spark, tmp_path):
    rows = [(1, None, "a", 1), (None, "x y", None, 2), (None, "x y", None, 2), (2, "", "b", 3), (3, "p q r s t u", "b", 4), (3, "p q r s t u", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = set()
    for name, stage in CP.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        texts = Counter((r["text"] or "") for r in docs.collect())
    assert texts == Counter(["", "x y", "p q r s t u"])
    empty = docs.limit(0)
    for name, stage in CP.STAGES:
        empty = written(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0


#: Names that stages give to columns of their own.
CLASH = "_fp string, _copy int, _copies string, _doc_id long, _source int, _text_fp string, _gone_id string, _sha string, score double, kept int"


def test_pipeline_matches_plain_stages(spark, tmp_path):
    """All stages over texts with insults, copies, near copies, a very long text, ties, nulls and clashing columns."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += [t.replace(" ", "\n", 2) for t in texts[:8]] + [t + " tail" for t in texts[8:20]] + [f"{t} you idiot" for t in texts[20:26]]
    texts += [" ".join(word() for _ in range(30_000)), "", None, "  ", "you are a stupid loser"]
    rows = [(k, t, rng.choice(["a", "b", "b", "b", None])) for k, t in enumerate(texts)] + [(3, texts[3], "a"), (None, "no id here", "b"), (None, "no id here", None)]
    clash = ("x", 1, "y", 2, 3, "z", "g", "s", 0.5, 1)
    spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, source string, {CLASH}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(20 <= k < 26)) for k in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    scorer = Scorer(learn_lexicon(docs, table(spark, str(tmp_path), "labels")))
    low = lambda i: (i is None, i or 0)

    def took(name, before, after):
        if name == "toxicity":
            assert Counter(after) == Counter(r for r in before if scorer.score(r[1] or "") < 0.3)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
            want = [sorted(g, key=lambda r: low(r[0]))[0] for g in groups.values()]
            assert Counter(r[:2] for r in after) == Counter(r[:2] for r in want)
        elif name == "near_dedup":
            sets, root = plain_components(before, 80)
            groups = defaultdict(list)
            for k, r in enumerate(before):
                groups[root[k] if sets[k] else -k - 1].append(r)
            assert Counter(r[0] for r in after) == Counter(sorted(g, key=lambda r: low(r[0]))[0][0] for g in groups.values())
        elif name == "mix":
            key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
            hashed = spark.createDataFrame([(k, *r) for k, r in enumerate(before)], "k long, doc_id long, text string, source string").select("k", F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), key, F.xxhash64(F.coalesce("text", F.lit("")))).alias("h"))
            copies = plain_mix(before, {r["k"]: r["h"] for r in hashed.collect()})
            assert Counter(after) == Counter({r: n for r, n in zip(before, copies, strict=True) if n})

    for name, stage in CP.STAGES[:-1]:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and all(tuple(r)[3:] == clash for r in docs.collect())
        took(name, before, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    since = set(made_paths(spark))
    packed = CP.run(spark, str(tmp_path)).collect()
    assert len(set(made_paths(spark)) - since) < 8
    words, size, bins = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in packed:
        words[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    for r in docs.collect():
        size[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert words == size
    for parts in bins.values():
        assert sum(r["length"] for r in parts) == parts[0]["bin_used"] <= 2048
        assert max(Counter(r["doc_id"] for r in parts if r["length"]).values(), default=1) == 1


def test_queries_return_the_contract(spark):
    want = {
        "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op3_find_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op4_token_files": "doc_id start n_tokens ids_crc32",
        "op5_near_dedup": "doc_id n_shingles component_id kept",
        "op6_score_toxicity": "doc_id held_out score predicted",
        "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_mix_sources": "doc_id size source_size target taken",
        "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
    }
    n = table(spark, SF, "documents").count()
    for name, columns in want.items():
        got = LQ.QUERIES[name](spark, SF)
        assert got.columns[: len(columns.split())] == columns.split(), name
        assert got.count() == n, name
