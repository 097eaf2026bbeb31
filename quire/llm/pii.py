"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of
from quire.llm.quality import let


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.reverse(F.split(digits, ""))
    values = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 once its first four characters stand last."""
    moved = F.split(F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97) == 1


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: The length of an IBAN and the countries that have it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """An IBAN of its country's length; of a country without a known one, the longest run up to the next IBAN."""
    known = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    known = rf"(?:{known})(?![A-Za-z0-9])"
    codes = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?:\x20?(?!(?<![A-Za-z0-9]){known})[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


class Kind(NamedTuple):
    """A kind of personal data.

    ``pattern`` proposes spans; its repeats are possessive and its start is
    tied to a run's start or the last match's end wherever that changes no
    match, so that no text takes quadratic time. ``valid`` confirms a match. A
    span's score is ``base`` plus ``context_gain`` where a word of ``context``
    stands within ``CONTEXT_CHARS`` before it. ``always`` spans stay whatever
    their score.
    """

    name: str
    probe: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    base: float
    context: str
    always: bool


CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.35
#: Spans of kinds that aren't ``always`` need this score.
ACCEPT = 0.6

KINDS = (
    Kind("email", lambda t: t.contains("@"),
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.9, r"\b(?:e-?mail|mail|contact|correo|courriel)\b", True),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\b(?:ip|address|host|server|client|login)\b", True),
    Kind("card", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
         r"[0-9](?:[\x20-]?[0-9])++",
         lambda m: F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m)), 0.8, r"\b(?:card|credit|visa|mastercard|karte|tarjeta|carte)\b", True),
    Kind("phone", lambda t: t.contains("+"),
         r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: F.length(digits_of(m)).between(8, 15), 0.6, r"\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b", True),
    Kind("iban", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
         iban_pattern(),
         lambda m: mod97(F.regexp_replace(m, r"\x20", "")), 0.8, r"\b(?:iban|konto|account|cuenta|compte|bank)\b", False),
    Kind("ssn", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
         r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda m: F.lit(True), 0.3, r"\b(?:ssn|social security)\b", False),
)

_SPAN = "array<struct<start:int,end:int,match:string,score:double>>"
#: Matches of a block: a match's place is its block's start and the lengths before it in the block.
_BLOCK = 64


def starts_of(lengths: Column) -> Column:
    """The sums of all lengths before each block."""
    total = lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int"))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.array_append(a, F.element_at(a, -1) + total(b)))


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind: leftmost, non-overlapping, in code points, ends exclusive.

    Places are sums of lengths in blocks, and what an aggregate carries is copied for each of its elements, so
    that none carries more than a number but over blocks: the time is linear in the matches for all but
    texts of many millions.
    """
    none = F.array().cast(_SPAN)

    def confirmed(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))
        valid = F.filter(F.sequence(F.lit(0), F.size(matches) - 1), lambda i: kind.valid(F.get(matches, i)))
        last = lambda x: F.right(x, F.lit(CONTEXT_CHARS))

        def near(i: Column) -> Column:
            # a match has two characters or more
            before = F.transform(F.sequence(F.greatest(i - CONTEXT_CHARS // 2, F.lit(0)), i), lambda j: F.concat(last(F.get(gaps, j)), F.when(j < i, last(F.get(matches, j))).otherwise("")))
            return last(F.array_join(before, ""))

        def spans(lengths: Column, starts: Column) -> Column:
            def span(i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                inside = F.aggregate(F.slice(lengths, block * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, x: a + x)
                gain = F.when(F.lower(near(i)).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
                match, score = F.get(matches, i), F.least(F.lit(1.0), F.lit(kind.base) + gain)
                start = F.get(starts, block) + inside + F.char_length(F.get(gaps, i))
                return let(start, lambda s: F.struct(s.alias("start"), (s + F.char_length(match)).alias("end"), match.alias("match"), score.alias("score")))

            return F.transform(valid, span)

        found = let(lengths, lambda n: let(starts_of(n), lambda s: spans(n, s)))
        return F.when(F.size(matches) > 0, found).otherwise(none)

    matched = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    out = let(matched, lambda m: let(F.split(text, kind.pattern, -1), lambda g: confirmed(m, g)))
    if not kind.always:
        out = F.filter(out, lambda s: s["score"] >= ACCEPT)
    return F.when(kind.probe(text), out).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data in each text: no shuffle, a row per input row.

    Columns: ``doc_id`` and, for each kind, an array of (start, end, match,
    score). Offsets are code points. A null or empty text has none. Matches
    that their checksum refutes are dropped and not tried again from inside.
    Repeated rows give equal results; an empty table an empty one; other columns
    aren't read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return d.select("doc_id", *[spans_of(F.col("text"), k).alias(k.name) for k in KINDS])


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def score_list(kinds: list[str]) -> Column:
    """The scores of the spans of ``span_list``, in the same order."""
    each = [F.transform(F.col(k), lambda s: F.format_string("%.2f", s["score"])) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span of one kind, in order, replaced by as many asterisks."""
    step = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit("*"), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(spans, text, step)
