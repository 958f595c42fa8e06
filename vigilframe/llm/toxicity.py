"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause word by word: one for insults, one each for threats, targets, negation and
reported speech. Their composition is one machine whose states are tuples of theirs; its arcs carry the
weight of the word times what its reading leaves of it: all if it is thrown at somebody, less if it is reported,
least if it is denied. Clauses are scored, never single words out of their clause.

The insult transducer's arcs (words and beginnings of words, with weights) are learned from labelled documents. A
beginning is an arc only if toxic documents have it in several words, and with evidence left when the most frequent
of them is taken away; of several arcs the longest one counts, a whole word before any beginning. What a clause's readings are worth is learned from other labelled documents than the arcs, so that arcs that
fit by chance get no credit. Both take TRAIN_ROWS labelled documents at most, chosen by a hash of their ids;
scoring covers every document and its whole text. Nothing but the text enters a score.

Defined cases: null and empty texts have the score of a text without any match; documents with several labels
count as toxic if one of them says so; null labels are ignored; without labels of both kinds the machine keeps its prior
weights; repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import map_texts, written

TRAIN_ROWS = 200_000
HELD_OUT = 5
#: Arcs need this many toxic documents and this share of them; the strongest MOST_ARCS are kept.
LEAST_DOCUMENTS, LEAST_SHARE, MOST_ARCS = 3, 0.002, 20_000
#: A beginning needs so many different words.
LEAST_WORDS = 3
BEGINNINGS = range(4, 10)
#: Learned weights start from these, so that a few labels can't turn a reading around. All but the constant stay at 0
#: or above: more insults never make a text less toxic.
PRIOR, STIFFNESS = np.array([-3.0, 0.6, 0.4, 0.2, 0.2, 0.3]), 1.0
REMEMBERED = 100_000
#: Rejected documents that are broadcast at most.
BROADCAST_ROWS = 1_000_000

# fixed values: function words of four languages
THREATS = frozenset(
    "kill hurt destroy burn beat stab shoot strangle murder töten umbringen verprügeln schlagen vernichten tuer "
    "frapper brûler détruire matar golpear quemar destruir".split()
)
TARGETS = frozenset(
    "you your yours yourself he him she her they them du dich dir dein ihr euch sie tu toi te vous vos ils elles "
    "tú ti usted ustedes vosotros ellos ellas".split()
)
NEGATIONS = frozenset(
    "not never no nobody neither nor isn aren wasn don doesn nicht nie kein keine keinen ne pas jamais aucun nunca "
    "jamás ningún tampoco".split()
)
REPORTS = frozenset(
    "said says say called calls wrote writes quoted reported claimed alleged sagte sagt nannte schrieb dit disait "
    "appelé écrit dijo dice llamó escribió".split()
)

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»„]")
_BREAKS, _QUOTES = frozenset(".!?;\n"), frozenset("\"“”«»„")
#: What a reading leaves of a word's weight: plain, denied, reported.
LEFT = (1.0, 0.1, 0.4)


class Transducer:
    """States and arcs of one pattern; symbols without an arc lead to the state's default."""

    def __init__(self, start, arcs: dict, default: dict | None = None):
        self.start, self.arcs, self.default = start, arcs, default or {}
        self.states = {start, *(s for s, _ in arcs), *arcs.values(), *self.default, *self.default.values()}

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), self.default.get(state, state))


def grammar() -> list[Transducer]:
    """Seen an insult, seen a threat, seen a target, words since a negation, inside reported speech."""
    insult = Transducer(0, {(0, INSULT): 1})
    threat = Transducer(0, {(0, THREAT): 1})
    target = Transducer(0, {(0, TARGET): 1})
    # a negation holds for the three words after it
    negation = Transducer(
        0, {(s, NEGATION): 3 for s in range(4)}, default={0: 0, 1: 0, 2: 1, 3: 2}
    )
    reported = Transducer(0, {(0, REPORT): 2, (0, QUOTE): 1, (1, QUOTE): 0, (2, QUOTE): 1})
    return [insult, threat, target, negation, reported]


def compose(parts: list[Transducer]) -> tuple[int, list[list[int]], list[int], list[tuple]]:
    """(start, next state by state and symbol, reading by state, states) of all machines run together.

    The reading belongs to the state before the word: what a word means depends on what came before it.
    """
    states = list(product(*(sorted(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    moves = [[number[tuple(p.step(x, symbol) for p, x in zip(parts, s))] for symbol in range(7)] for s in states]
    readings = [1 if s[3] else 2 if s[4] else 0 for s in states]
    return number[tuple(p.start for p in parts)], moves, readings, states


class Machine:
    """Scores texts with learned arcs: {word or beginning*: weight}."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs = arcs
        self.start, self.moves, self.readings, self.states = compose(grammar())
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        word = token.lower()
        if word in _QUOTES:
            return QUOTE, 0.0
        weight = self.arcs.get(word, 0.0)
        for k in reversed(BEGINNINGS):  # the longest arc
            if not weight and len(word) > k:
                weight = self.arcs.get(word[:k] + "*", 0.0)
        if weight > 0:
            return INSULT, weight
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return symbol, 0.0
        return WORD, 0.0

    def readings_of(self, text: str) -> list[float]:
        """1, best clause, all clauses (log), weight a word, best targeted clause, threats."""
        best = targeted = total = score = 0.0
        threats = words = 0
        state = self.start
        known, moves, readings = self.known, self.moves, self.readings
        if len(known) > REMEMBERED:
            known.clear()
        for token in [*_TOKENS.findall(text), "."]:
            if token in _BREAKS:
                if state != self.start:
                    total += score
                    best = max(best, score)
                    _, threat, target, _, _ = self.states[state]
                    if target:
                        targeted = max(targeted, score)
                        threats += threat
                    state, score = self.start, 0.0
                continue
            found = known.get(token)
            if found is None:
                found = known[token] = self.symbol(token)
            words += 1
            symbol, weight = found
            if weight:
                score += weight * LEFT[readings[state]]
            state = moves[state][symbol]
        return [1.0, best, math.log1p(total), 10 * total / (words + 10), targeted, math.log1p(threats)]


def features_of(text: str) -> set[str]:
    """The words of a text and the beginnings of its words."""
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", text)}
    return words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) > k}


def learn_arcs(labelled: DataFrame) -> dict[str, float]:
    """Log odds of words and beginnings, less one standard error, from rows (text, toxic).

    Candidates are what enough toxic documents have; only those are counted in the others.
    """

    def counted(frames: Iterator[pd.DataFrame], wanted: set[str] | None) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                found = features_of(text)
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > REMEMBERED:
                    yield pd.DataFrame(list(counts.items()), columns=["feature", "n"])
                    counts.clear()
        yield pd.DataFrame(list(counts.items()), columns=["feature", "n"])

    def documents_with(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
        parts = map_texts(rows.select("text"), lambda frames: counted(frames, wanted), "feature string, n long")
        return parts.groupBy("feature").agg(F.sum("n").alias("n"))

    sizes = dict(labelled.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * toxic))
    # a share of the toxic documents bounds this list by their mean number of words over that share
    counted_own = written(documents_with(labelled.where("toxic = 1"), None), "toxic-features")
    own = {r.feature: r.n for r in counted_own.where(F.col("n") >= least).collect()}
    single = beginnings(counted_own)
    others = documents_with(labelled.where("toxic = 0"), set(own))
    others = {r.feature: r.n for r in others.collect()}
    arcs = {}
    sure = max(10.0, 2 * math.log(max(1, len(own))))  # so many candidates have chances to fit by accident
    for feature, a in own.items():
        b = others.get(feature, 0)
        if feature.endswith("*"):
            words, most, word = single.get(feature, (0, 0, ""))
            # what is left when its most frequent word is taken away; documents with both count against it
            a, b = a - most, max(0, b - others.get(word, 0))
            if words < LEAST_WORDS or a < least:
                continue
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        even = (a + b) / (toxic + clean)
        ratio = 2 * (a * math.log(a / (toxic * even)) + (b * math.log(b / (clean * even)) if b else 0.0))
        if odds > error + 0.5 and ratio > sure:
            arcs[feature] = odds - error
    # a beginning of a longer one needs words of its own, too
    arcs = {f: w for f, w in arcs.items() if not f.endswith("*") or not explained(f, arcs, own, least)}
    strongest = sorted(arcs, key=lambda f: (-arcs[f], f))[:MOST_ARCS]
    return {f: arcs[f] for f in strongest}


def beginnings(counted: DataFrame) -> dict[str, tuple[int, int, str]]:
    """Of each beginning of several words: how many words, and documents of the most frequent one and its name.

    ``counted`` has the documents of each word; words of fewer than two documents are no witnesses.
    """
    words = counted.where("n > 1 AND NOT endswith(feature, '*')")
    parts = F.transform(F.sequence(F.lit(BEGINNINGS[0]), F.lit(BEGINNINGS[-1])), lambda k: F.when(F.length("feature") > k, F.substring("feature", 1, k)))
    below = words.select(F.explode(F.array_compact(parts)).alias("part"), "feature", "n")
    found = below.groupBy("part").agg(F.count("*").alias("words"), F.max(F.struct("n", "feature")).alias("most"))
    rows = found.where(F.col("words") >= LEAST_WORDS).orderBy(F.col("most.n").desc(), "part").limit(10 * MOST_ARCS).collect()
    return {f"{r.part}*": (r.words, r.most.n, r.most.feature) for r in rows}


def explained(feature: str, arcs: dict[str, float], own: dict[str, int], least: int) -> bool:
    """Whether a longer beginning has nearly all the toxic documents of this one."""
    stem = feature[:-1]
    return any(f.endswith("*") and len(f) > len(feature) and f.startswith(stem) and own[f] + least > own[feature] for f in arcs)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``newton`` with all weights but the constant at 0 or above: those that would be negative are left out."""
    used = np.arange(x.shape[1])
    while True:
        weights = np.zeros(x.shape[1])
        weights[used] = newton(x[:, used], y, PRIOR[used])
        bad = np.flatnonzero(weights[1:] < 0) + 1
        if not len(bad):
            return weights
        used = np.setdiff1d(used, bad)


def newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, held to the prior by STIFFNESS (the constant is nearly free)."""
    hold = np.array([1e-3, *[STIFFNESS] * (len(prior) - 1)])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + hold @ (w - prior) ** 2 / 2)

    weights, now = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        slope = x.T @ (y - p) - hold * (weights - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), slope)
        while (after := loss(weights + step)) > now and np.abs(step).max() > 1e-10:
            step /= 2
        if after > now or now - after < 1e-10 * max(1.0, now):
            break
        weights, now = weights + step, after
    return weights


def remainder(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT))


def likeness(text: str) -> Column:
    """The three smallest hashes of a text's words: nearly always the same in copies with a few changes."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"))
    return F.xxhash64(F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 3))


class Judge:
    """What is learned: the machine's arcs and the worth of its readings."""

    def __init__(self, arcs: dict[str, float], weights: np.ndarray):
        self.arcs, self.weights = arcs, weights


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Judge:
    """Learns from labelled documents that aren't held out; ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder() != 0)
    share = min(1.0, rows / max(1, known.count()))
    # about ``rows`` rows of 12 bytes, whatever the number of labels
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    # copies are one witness: of documents that are alike and have the same label, the first counts
    alike = docs.join(chosen, "doc_id").select("doc_id", "toxic", likeness("text").alias("_alike"))
    first = written(alike.groupBy("_alike", "toxic").agg(F.min("doc_id").alias("doc_id")), "toxic-sample")
    first = F.broadcast(first.select("doc_id", "toxic").distinct())  # no more rows than ``chosen``
    labelled = docs.join(first, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    arcs = learn_arcs(labelled.where(remainder() != HELD_OUT - 1))
    read = readings(labelled.where(remainder() == HELD_OUT - 1).select("text", "toxic"), arcs)
    read = read.select("readings", "toxic").collect()  # a quarter of the sample, six numbers each
    y = np.array([r.toxic for r in read], dtype=np.float64)
    both = 0 < y.sum() < len(y)
    return Judge(arcs, fit(np.array([r.readings for r in read]), y) if both else PRIOR)


def readings(rows: DataFrame, arcs: dict[str, float], text: str = "text") -> DataFrame:
    """The array ``readings`` in place of the text column."""
    shared = rows.sparkSession.sparkContext.broadcast(arcs)  # MOST_ARCS at most

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine(shared.value)
        for frame in frames:
            texts = frame.pop(text)
            yield frame.assign(readings=[machine.readings_of(t) for t in texts])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return map_texts(rows, batches, f"{kept}, readings array<double>")


def score(docs: DataFrame, judge: Judge, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (under whatever names), then score (0 to 1) and predicted (0 or 1)."""
    inner = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], F.coalesce("text", F.lit("")).alias("_read")
    )
    worth = F.array(*[F.lit(float(w)) for w in judge.weights])
    total = F.aggregate(F.zip_with("readings", worth, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = readings(rows, judge.arcs, "_read").withColumn("_score", F.lit(1.0) / (1.0 + F.exp(-total)))
    return scored.select(
        *[F.col(i).alias(c) for c, i in zip(keep, inner)],
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", key.alias("_text"))
    scored = score(rows, train(docs.select("doc_id", "text"), labels), ("doc_id", "_text"))
    toxic = written(scored.where("predicted = 1").select("doc_id", "_text").distinct(), "toxic-documents")
    toxic = toxic.select(F.col("doc_id").alias("_toxic_id"), "_text")
    # texts move only where the rejected ones are too many to broadcast
    toxic = F.broadcast(toxic) if toxic.count() <= BROADCAST_ROWS else toxic
    same = docs["doc_id"].eqNullSafe(toxic["_toxic_id"]) & (key == toxic["_text"])
    return docs.join(toxic, same, "left_anti")


def toxicity(docs: DataFrame, labels: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document of ``judged`` (``docs`` if not given)."""
    scored = score(docs if judged is None else judged, train(docs, labels))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")
