"""Toxicity by a weighted grammar of finite-state transducers over clauses."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_of, written
from quire.llm.quality import let

#: The grammar's own lexicon, in four languages. Weights are log-odds.
INSULTS = (
    "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile bastard asshole dumbass jerk vermin filth creep dimwit fool "
    "idioten arschloch dummkopf abschaum trottel schwachkopf missgeburt hurensohn drecksau versager "
    "connard imbécile abruti crétin ordure salaud enfoiré débile "
    "imbécil estúpido estúpida pendejo cabrón basura inútil asqueroso gilipollas maldito"
).split()
THREATS = "kill hurt destroy stab shoot strangle beat burn töten umbringen vernichten erschießen verprügeln tuer frapper détruire étrangler matar golpear destruir apuñalar quemar".split()
MODALS = "will gonna shall should must 'll werde sollte muss wirst vais va doit devrait voy vas debe debería".split()
TARGETS = "you your yourself u he she they them him her du dich dir ihr euch sie tu toi te vous ils elles tú usted ustedes ellos ti".split()
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says told reported quoted wrote claims alleged sagte berichtet schrieb behauptet zitiert dit déclaré écrit selon dijo dice escribió según".split()

INSULT_WEIGHT = 5.0
THREAT_WEIGHT = 4.0
#: Factors on a clause's insults and threats.
TARGETED, NEGATED, REPORTED = 1.15, 0.6, 0.7
#: Words within which a negation reaches.
REACH = 3
#: Log-odds of a text without any evidence.
PRIOR = math.log(0.1 / 0.9)

#: Letters of the shortest word beginnings that learning considers, and of the longest of its first round; each round doubles them.
SHORTEST, FIRST_ROUND = 3, 12
#: Labelled rows of each class that learning takes at most; more change little.
SAMPLE_ROWS = 6000
#: Least G-square of a beginning, beyond twice the logarithm of how many are tried.
LEAST_G2 = 2

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n|]+")

#: Word classes, the input symbols of the clause grammar: other, insult, threat verb, modal, target, negation, report.
CLASSES = "oITMYNR"
#: Output symbols that are evidence: an insult, an insult in a clause with a target, a threat.
EVIDENCE = "IJt"


class Transducer:
    """A weighted finite-state transducer over symbols.

    ``arcs`` map a state and an input symbol to (next state, output symbol,
    factor), or to None where the path ends. A symbol that a state doesn't name
    takes its "*" arc; an output "=" is the input. A path counts if it
    ends in one of ``finals``.
    """

    def __init__(self, starts: Iterable, finals: Iterable, arcs: dict):
        self.starts, self.finals, self.arcs = tuple(starts), frozenset(finals), arcs

    def step(self, state, symbol: str) -> tuple | None:
        own = self.arcs[state]
        arc = own[symbol] if symbol in own else own.get("*")
        return arc and (arc[0], symbol if arc[1] == "=" else arc[1], arc[2])

    def then(self, other: Transducer, alphabet: str = CLASSES) -> Transducer:
        """The composition: ``other`` reads what this one writes, and factors multiply."""
        arcs: dict = {}
        open_ = [(p, q) for p in self.starts for q in other.starts]
        starts = tuple(open_)
        while open_:
            p, q = state = open_.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol in alphabet:
                if (own := self.step(p, symbol)) and (theirs := other.step(q, own[1])):
                    after = own[0], theirs[0]
                    arcs[state][symbol] = after, theirs[1], own[2] * theirs[2]
                    open_.append(after)
        return Transducer(starts, [(p, q) for p, q in arcs if p in self.finals and q in other.finals], arcs)

    def weigh(self, symbols: Iterable[str], weights: Iterable[float]) -> float:
        """What the paths that count add up to: along a path, the weights of evidence times the factors of its arcs."""
        paths = [(state, 0.0) for state in self.starts]
        for symbol, weight in zip(symbols, weights, strict=True):
            after = []
            for state, total in paths:
                if arc := self.arcs[state].get(symbol):
                    after.append((arc[0], total + weight * arc[2] if arc[1] in EVIDENCE else total))
            paths = after
        return sum(total for state, total in paths if state in self.finals)


def _countdown(opener: str, reach: int, inside: dict, outside: dict) -> Transducer:
    """For ``reach`` words after ``opener`` the arcs are ``inside``, else ``outside``: symbol to (output, factor)."""
    arcs = {}
    for k in range(reach + 1):
        arcs[k] = {symbol: (max(0, k - 1), *to) for symbol, to in (inside if k else outside).items()}
        arcs[k][opener] = (reach, "=", 1.0)
        arcs[k]["*"] = (max(0, k - 1), "=", 1.0)
    return Transducer([0], range(reach + 1), arcs)


#: A modal makes a threat verb within four words after it a threat: "will ... kill". Other threat verbs are ordinary words.
THREAT = _countdown("M", 4, {"T": ("t", 1.0)}, {"T": ("o", 1.0)})
#: A clause has a target or it has none, which is known at its end. One path takes it to have none, and ends at the
#: first; on it threats are nobody's. The other waits for one, and doesn't count before it came.
TARGET = Transducer(
    ["none", "awaited"], ["none", "seen"],
    {
        "none": {"Y": None, "t": ("none", "o", 1.0), "*": ("none", "=", 1.0)},
        "awaited": {"Y": ("seen", "=", 1.0), "I": ("awaited", "J", TARGETED), "t": ("awaited", "t", TARGETED), "*": ("awaited", "=", 1.0)},
        "seen": {"I": ("seen", "J", TARGETED), "t": ("seen", "t", TARGETED), "*": ("seen", "=", 1.0)},
    },
)
#: A negation weakens the insults and threats that follow closely.
NEGATION = _countdown("N", REACH, {x: ("=", NEGATED) for x in EVIDENCE}, {})
#: A report of speech weakens all that follow in its clause.
REPORT = Transducer(
    [0], [0, 1],
    {0: {"R": (1, "=", 1.0), "*": (0, "=", 1.0)}, 1: {x: (1, "=", REPORTED) for x in EVIDENCE} | {"*": (1, "=", 1.0)}},
)


def _numbered(machine: Transducer) -> Transducer:
    """The same with numbers for states."""
    number = {state: k for k, state in enumerate(machine.arcs)}
    arcs = {number[p]: {x: (number[to], out, f) for x, (to, out, f) in own.items()} for p, own in machine.arcs.items()}
    return Transducer([number[x] for x in machine.starts], [number[x] for x in machine.finals], arcs)


#: The whole grammar of a clause, over word classes.
CLAUSE = _numbered(THREAT.then(TARGET).then(NEGATION).then(REPORT))


@dataclass(frozen=True)
class Lexicon:
    """What words weigh, and how evidence becomes a score.

    ``stems`` are weighted beginnings of words that labels marked; ``scale``
    turns a text's evidence into log-odds: a constant, and factors of the
    logarithms of evidence and of evidence per thousand words.
    """

    stems: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, float, float] = (PRIOR, 2.0, 0.0)


class InsultTransducer:
    """Reads a word by letters and writes its class, with the weights of its arcs added up.

    The arcs are a tree of the lexicon's beginnings: the arcs to a beginning
    weigh together what it weighs, so that a word has the weight of its longest
    known beginning. A word that ends where one of the grammar's own words does
    is of that word's class, unless a beginning made it an insult.
    """

    def __init__(self, lexicon: Lexicon):
        self.arcs: list[dict[str, tuple[int, float]]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        reached = [0.0]
        for stem, weight in sorted(lexicon.stems.items()):  # shorter beginnings come first
            node = 0
            for letter in stem[:-1]:
                node = self._arc(node, letter, reached)
            end = self._arc(node, stem[-1], reached, weight)
            reached[end] = weight
        for symbol, words in (("T", THREATS), ("M", MODALS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("I", INSULTS)):
            for word in words:
                node = 0
                for letter in word:
                    node = self._arc(node, letter, reached)
                # an insult of the grammar's own weighs at least so much
                self.ends[node] = (symbol, max(0.0, INSULT_WEIGHT - reached[node]) if symbol == "I" else 0.0)

    def _arc(self, node: int, letter: str, reached: list[float], weight: float | None = None) -> int:
        held = self.arcs[node].get(letter)
        after = held[0] if held else len(self.arcs)
        if not held:
            self.arcs.append({})
            reached.append(reached[node])
        if not held or weight is not None:
            self.arcs[node][letter] = after, (reached[node] if weight is None else weight) - reached[node]
        return after

    def read(self, word: str) -> tuple[str, float]:
        node, total = 0, 0.0
        for letter in word:
            arc = self.arcs[node].get(letter)
            if arc is None:
                return ("I", total) if total > 0 else ("o", 0.0)
            node, total = arc[0], total + arc[1]
        symbol, weight = self.ends.get(node, ("o", 0.0))
        total += weight
        if total > 0:
            return "I", total
        return symbol, THREAT_WEIGHT if symbol == "T" else 0.0


class Scorer:
    """Scores texts by their clauses, and remembers what it read of words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.insults = InsultTransducer(lexicon)
        self.known: dict[str, tuple[str, float]] = {}

    def score(self, text: str) -> float:
        """The probability that a text is toxic."""
        odds = sum(a * b for a, b in zip(self.lexicon.scale, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    def features(self, text: str) -> tuple[float, float, float]:
        evidence = self.evidence(text)
        return 1.0, math.log1p(evidence), math.log1p(1000 * evidence / (1 + text.count(" ")))

    def evidence(self, text: str) -> float:
        low = text.lower()
        known = self.known
        if len(known) > 500_000:
            known.clear()
        words = set(_WORD.findall(low))
        for w in words.difference(known):
            known[w] = self.insults.read(w)
        if not any(known[w][1] for w in words):
            return 0.0
        return sum(self.clause(_WORD.findall(c)) for c in _CLAUSE.split(low))

    def clause(self, words: list[str]) -> float:
        """The log-odds that a clause adds: what the grammar's paths over it weigh."""
        read = [self.known.get(w) or self.insults.read(w) for w in words]
        if not any(weight for _, weight in read):
            return 0.0
        return CLAUSE.weigh(*zip(*read, strict=True))


def learnable(id_col: str) -> Column:
    """Whether labels of a row may be learned from: CRC-32 of its id as text, modulo 4, isn't 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def single_texts(texts: DataFrame) -> DataFrame:
    """The rows of (doc_id, label, text) without copies: one of those that share a least hash of 3-word windows, by either of two hashes.

    Copies would make each of their rare words look like a mark of their class.
    """
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")

    def least(w: Column, seed: int) -> Column:
        return F.array_min(F.transform(w, lambda x, i: F.xxhash64(F.lit(seed), x, F.get(w, i + 1), F.get(w, i + 2))))

    keyed = texts.withColumn("least", let(words, lambda w: F.array(least(w, 1), least(w, 2))))
    for k in (0, 1):
        first = F.row_number().over(Window.partitionBy(F.col("least")[k]).orderBy("doc_id", "label"))
        keyed = keyed.withColumn("place", first).filter("place = 1")
    return written(keyed.select("doc_id", "label", "text"), "marked")


def beginnings(texts: DataFrame, least: int) -> DataFrame:
    """(stem, t, c): the beginnings of words, of any length, that ``least`` rows or more of (label, text) have, by label 1 and 0.

    A beginning that so many rows have begins with one that they have too, so that each
    round only goes on with words whose beginning of the last round's length
    was found; the rounds end with the words.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    open_ = texts.select(F.monotonically_increasing_id().alias("row"), "label", words.alias("words"))
    shortest, longest, found = SHORTEST, FIRST_ROUND, []
    while True:
        lengths = lambda w: F.sequence(F.lit(shortest), F.least(F.length(w), F.lit(longest)))  # noqa: B023, E731
        starts = lambda w: F.transform(lengths(w), lambda k: F.substring(w, F.lit(1), k))  # noqa: B023, E731
        begin = open_.select("label", F.explode(F.array_distinct(F.flatten(F.transform("words", starts)))).alias("stem"))
        counts = begin.groupBy("stem").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        found.append(written(counts.filter(F.col("t") + F.col("c") >= least), "counts"))
        full = found[-1].filter(F.length("stem") == longest).select("stem")
        if full.isEmpty():
            break
        longer = open_.select("row", "label", F.explode("words").alias("word")).filter(F.length("word") > longest)
        longer = longer.withColumn("stem", F.substring("word", 1, longest)).join(full, "stem", "left_semi")
        open_ = written(longer.groupBy("row", "label").agg(F.collect_list("word").alias("words")), "open")
        shortest, longest = longest + 1, 2 * longest
    return reduce(DataFrame.unionByName, found)


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Weighted word beginnings, and the scale of evidence, from labelled rows outside the held-out quarter.

    Of each class the ``sample_rows`` rows with the least hash of id are taken,
    and of copies among them one. A beginning enters if texts of class 1 have it more often than chance
    allows (G-square, over all beginnings) and two fifths of its texts at least
    are of that class, unless a longer one has nearly all of its toxic texts
    and fewer others. Its weight is its smoothed log-odds. The scale is fitted
    to the same rows by logistic regression. Labels other than 0 and 1 and rows
    without text are passed over; an id with both labels stands in both classes; without rows of both classes the grammar's
    own lexicon serves.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1) & learnable(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    place = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [marked.filter(F.col("label") == k).orderBy(place, "doc_id").limit(sample_rows) for k in (0, 1)]
    sampled = written(parts[0].unionByName(parts[1]), "sampled")
    # the sample bounds these rows; they are written once, and all that follows reads them alone
    labelled = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(sampled), "doc_id")
    marked = single_texts(written(labelled.select("doc_id", "label", "text"), "labelled"))
    total = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    counts = beginnings(marked, 4)
    t, c = F.col("t"), F.col("c")
    share = toxic / (toxic + clean)
    g2 = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    least = LEAST_G2 + 2 * math.log(1 + counts.count())
    chosen = counts.filter((t >= 4) & (3 * t >= 2 * c)).withColumn("g2", g2).filter(F.col("g2") >= least).select("stem", "t", "c", odds.alias("weight"), "g2")
    # four labelled rows and more have each of them, so that the sample bounds how many there are
    rows = chosen.collect()
    stems = {r["stem"]: r for r in rows}
    for r in rows:
        for k in range(SHORTEST, len(r["stem"])):
            shorter = stems.get(r["stem"][:k])
            if shorter and r["t"] >= 0.9 * shorter["t"] and r["c"] < shorter["c"]:
                del stems[r["stem"][:k]]
    lexicon = Lexicon({s: round(r["weight"], 6) for s, r in stems.items()})

    def measure(batches):
        scorer = Scorer(lexicon)
        for batch in batches:
            found = [scorer.features(x)[1:] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], ["label", "a", "b"])

    found = np.array(marked.select("label", "text").mapInArrow(measure, "label double, a double, b double").collect())
    return Lexicon(lexicon.stems, logistic(found[:, 1:], found[:, 0]))


def logistic(features: np.ndarray, label: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> tuple[float, float, float]:
    """Constant and factors of a logistic regression by Newton's method, slightly shrunk."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (label - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(b), 9) for b in beta)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) of every whole text.

    A null text is an empty one, whose score is the prior. Repeated rows score
    alike; an empty table gives an empty result; other columns aren't read.
    """

    return docs.select(F.col(id_col).alias("doc_id"), score_of(text_of(text_col), lexicon).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_of(text: Column, lexicon: Lexicon) -> Column:
    """The score of a text; of the columns beside it none leaves the JVM."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield pa.array(map(scorer.score, batch.to_pylist()), pa.float64())

    return scores(text)


def keep_civil(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns as they are."""
    return docs.filter(score_of(text_of(text_col), lexicon) < threshold)


def held_out(doc_id) -> bool:
    """The same rule as ``learnable``, for a single id."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
