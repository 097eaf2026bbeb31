"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import KINDS, find_pii, score_list, span_list

    base = ["email", "ip", "card", "phone"]
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list([k.name for k in KINDS]).alias("spans"),
        score_list([k.name for k in KINDS]).alias("scores"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3 SQL can express: the counts and places of the base kinds."""
    return op3_find_pii(spark, sf_dir).drop("spans", "scores")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import new_path
    from quire.llm.token_files import read_token_shards, write_token_shards

    folder = new_path(spark, "tokens")
    manifest = write_token_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_shards(manifest, folder)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.near_dedup import near_dedup

    found = near_dedup(table(spark, sf_dir, "documents"), threshold=0.85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import learn_lexicon, learnable, score_toxicity

    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licenses import document_path, scan_licenses

    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, document_path(docs))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can express: sizes, and the targets of sources."""
    return op9_mix_sources(spark, sf_dir).drop("taken")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op12_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.collocations import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.fill_middle import fill_middle, restored

    cut = fill_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_pack_documents, op3_find_pii, op4_token_files, op5_near_dedup, op6_score_toxicity, op7_quality_rules, op8_scan_licenses,
        op9_mix_sources, op10_token_counts, op11_suffix_dedup, op12_mine_phrases, op13_fill_middle, pii_base, mix_targets,
    )
}


def _stop_words() -> str:
    from quire.llm.quality import STOP_WORDS

    return ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "pii_base": r"""
        WITH kinds(k, kind, pattern) AS (VALUES
            (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
            (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
            (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
            (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
        t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        cut AS (
            SELECT rid, 1 AS k, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m,
                   regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM t
            UNION ALL
            SELECT rid, 2, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), regexp_split_to_array(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM t
            UNION ALL
            SELECT rid, 3, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), regexp_split_to_array(text, '[0-9](?:[\x20-]?[0-9])+') FROM t
            UNION ALL
            SELECT rid, 4, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM t
        ),
        each AS (SELECT rid, k, generate_subscripts(m, 1) AS i, unnest(m) AS m, gaps FROM cut WHERE len(m) > 0),
        sized AS (
            SELECT rid, k, i, m, length(m) AS n, regexp_replace(m, '[^0-9]', '', 'g') AS digits, sum(length(gaps[i]) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS upto FROM each
        ),
        good AS (
            SELECT rid, k, upto - n AS a, upto AS b FROM sized
            WHERE k = 1
               OR (k = 2 AND list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS HUGEINT), 256) <= 255)))
               OR (k = 3 AND length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
                       CASE WHEN (length(digits) - j) % 2 = 0 THEN cast(digits[j] AS INT)
                            ELSE (2 * cast(digits[j] AS INT)) // 10 + (2 * cast(digits[j] AS INT)) % 10 END)) % 10 = 0)
               OR (k = 4 AND length(digits) BETWEEN 8 AND 15)
        ),
        found AS (
            SELECT rid, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
                   string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans
            FROM good JOIN kinds USING (k) GROUP BY rid
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(spans, '')) AS base_sha256
        FROM t LEFT JOIN found USING (rid)
    """,
    "op7_quality_rules": r"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        lists AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
        w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM lists),
        win AS (SELECT *, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
        counted AS (SELECT rid, i, a, CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, a, b, c) END AS n FROM win),
        covered AS (
            SELECT rid, a, greatest(n, coalesce(lag(n, 1) OVER p, 0), coalesce(lag(n, 2) OVER p, 0)) > 1 AS again FROM counted WINDOW p AS (PARTITION BY rid ORDER BY i)
        ),
        words AS (
            SELECT rid, count(*) AS n_words, sum(length(a)) AS word_chars, count(*) FILTER (again) AS n_repeat_words, count(*) FILTER (lower(a) IN (STOP_WORDS)) AS n_stop
            FROM covered GROUP BY rid
        ),
        lined AS (SELECT rid, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        lines AS (
            SELECT rid, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…|\|)[\x20\x09-\x0D]*$'))) AS n_cut,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks,
                   length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters
            FROM lined
        ),
        m AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, n_cut, n_marks, n_upper, n_letters, coalesce(n_stop, 0) AS n_stop,
                   coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
            FROM t JOIN lines USING (rid) LEFT JOIN words USING (rid)
        ),
        judged AS (
            SELECT *, concat_ws(',',
                CASE WHEN n_words < 50 THEN 'words' END,
                CASE WHEN coalesce(word_chars / nullif(n_words, 0), 0) NOT BETWEEN 2 AND 15 THEN 'word_length' END,
                CASE WHEN n_symbols / nullif(n_words, 0) > 0.3 THEN 'symbols' END,
                CASE WHEN n_marks / nullif(n_words, 0) > 0.3 THEN 'exclamations' END,
                CASE WHEN n_upper / nullif(n_letters, 0) > 0.5 THEN 'upper_case' END,
                CASE WHEN coalesce(n_stop / nullif(n_words, 0), 0) < 0.02 THEN 'stop_words' END,
                CASE WHEN n_repeat_words / nullif(n_words, 0) > 0.5 THEN 'repeated_words' END,
                CASE WHEN n_dup_lines / nullif(n_lines, 0) > 0.5 THEN 'repeated_lines' END,
                CASE WHEN n_cut / nullif(n_lines, 0) > 0.6 THEN 'cut_lines' END) AS failed
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged
    """.replace("STOP_WORDS", _stop_words()),
    "op11_suffix_dedup": r"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT rid, i, md5(b[i:i + 399]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM t)),
        again AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        marked AS (SELECT rid, i, coalesce(i > lag(i) OVER p + 400, true) AS fresh FROM again WINDOW p AS (PARTITION BY rid ORDER BY i)),
        numbered AS (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked),
        runs AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY rid, run),
        gaps AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS since FROM runs),
        cut AS (
            SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > since THEN hex(b[since:a - 1]) ELSE '' END, '' ORDER BY a) AS kept, max(z) AS last
            FROM gaps JOIN t USING (rid) GROUP BY rid
        )
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || CASE WHEN last <= octet_length(b) THEN hex(b[last:octet_length(b)]) ELSE '' END)) END AS kept_sha256
        FROM t LEFT JOIN cut USING (rid)
    """,
    "op12_mine_phrases": r"""
        WITH pieces AS (
            SELECT row_number() OVER () AS pid, lang, piece FROM (
                SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)
        ),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        grams AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists), range(1, 5) AS ks(k)
            WHERE i + k - 1 <= len(ws)
        ),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
        cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k >= 2),
        subs AS (
            SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longest
            FROM cand, range(2, 4) AS ms(m), range(1, 4) AS places(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
        ),
        kept AS (SELECT cand.* FROM cand LEFT JOIN subs USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a),
        cuts AS (
            SELECT kept.lang, kept.phrase, kept.a, c, l.a AS l, r.a AS r, (2000000::HUGEINT * kept.a // (l.a + r.a))::BIGINT AS score
            FROM kept, range(1, 4) AS cs(c), f AS l, f AS r
            WHERE c < kept.k AND l.lang = kept.lang AND l.phrase = array_to_string(ws[1:c], ' ') AND r.lang = kept.lang AND r.phrase = array_to_string(ws[c + 1:], ' ')
        ),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_fill_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        hashed AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM hashed
        ),
        parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE row_number() OVER (ORDER BY encode(source) NULLS LAST) % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM d GROUP BY source),
        r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS budget FROM s),
        -- the level at which all but the sources that are full by then use up the budget
        tried AS (SELECT a.ratio, a.budget, sum(least(b.cap, a.ratio * b.w)) AS used, sum(CASE WHEN b.ratio < a.ratio THEN b.cap ELSE 0 END) AS full_, sum(CASE WHEN b.ratio >= a.ratio THEN b.w ELSE 0 END) AS open_ FROM r a, r b GROUP BY a.source, a.ratio, a.budget),
        level AS (SELECT arg_min((budget - full_) / open_, ratio) AS level FROM tried WHERE used >= budget)
        SELECT doc_id, size, source_size, least(cap, level * w) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, level
    """,
}
