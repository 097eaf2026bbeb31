"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, WS_RUN, text_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from or had by not but what all were when we there can an your which their if do will how a he she i you me my our us so no "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch ich du wir ihr "
    "le la les de des un une et est en que qui dans du pour par sur au ce il ne pas plus se avec sont je tu nous vous elle lui mais ou où y "
    "el los las una unos por con para del al lo su sus como más pero este esta o sí porque muy sin sobre también me hasta hay donde quien desde todo nos durante yo tú no son fue ser"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A measure with the least and greatest value that pass; None is no bound."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: The production table. Measures are columns of ``measures``.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("exclamations", "exclamations_per_word", None, 0.3),
    Rule("upper_case", "upper_per_letter", None, 0.5),
    Rule("stop_words", "stop_words_per_word", 0.02, None),
    Rule("repeated_words", "repeats_per_word", None, 0.5),
    Rule("repeated_lines", "repeats_per_line", None, 0.5),
    Rule("cut_lines", "cut_lines_per_line", None, 0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more among ``words``, the first included."""

    def count(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def covered(hashes: Column) -> Column:
            placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def starts(p: Column) -> Column:
                again = F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]))
                return F.sort_array(F.array_compact(again))

            def spread(s: Column) -> Column:
                steps = F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3))))
                return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

            return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, lambda p: let(starts(p), spread)))

        return let(windows, covered)

    return let(words, count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row with the counts and ratios that rules may name."""
    text = F.col("text")
    words = F.array_remove(F.split(text, WS_RUN), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    d = d.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, WS_RUN, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("n_exclamations"),
        (F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))).alias("n_upper"),
        letters.alias("n_letters"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(?:\.\.\.|…|\|)[\x20\x09-\x0D]*$"))).alias("n_cut_lines"),
    )
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_exclamations", "n_words").alias("exclamations_per_word"),
        ratio("n_upper", "n_letters").alias("upper_per_letter"),
        ratio("n_stop_words", "n_words").alias("stop_words_per_word"),
        ratio("n_repeat_words", "n_words").alias("repeats_per_word"),
        ratio("n_dup_lines", "n_lines").alias("repeats_per_line"),
        ratio("n_cut_lines", "n_lines").alias("cut_lines_per_line"),
    )


def failures(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row of ``measures`` fails, in the table's order."""

    def failed(rule: Rule) -> Column:
        bounds = [F.col(rule.measure) < rule.least] if rule.least is not None else []
        bounds += [F.col(rule.measure) > rule.most] if rule.most is not None else []
        out = F.lit(False)
        for bound in bounds:
            out = out | bound
        return F.when(out, F.lit(rule.name))

    return F.array_compact(F.array(*[failed(r) for r in rules]))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts and verdicts by text: no shuffle, a row per input row.

    Columns: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (under 50 words, or
    over half of them in repeated 3-word windows), ``kept`` and ``failed``, the
    names of rules that the text fails. A null text is an empty one, which has
    no words and fails. Ratios over nothing are 0. Repeated rows are judged
    alike; an empty table gives an empty result; other columns aren't read.
    """
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("failed", failures(rules)).withColumn("base_failed", base)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )
