"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes (insult, threat, target, negation, reported speech, other) and clauses
are read by one machine composed from five two-state transducers; a matched clause
emits its weight under the context it stands in: plain, aimed at someone, negated, reported.
Insults and their weights come from labelled documents: word beginnings that toxic
documents hold and clean ones do not. A logistic model over the clause scores turns them
into a probability.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fresh, release, texts

#: Labelled rows that the model is fitted on at most: those with the smallest hash of their doc_id.
FIT_ROWS = 20_000
#: Beginnings of words that the lexicon learns.
PREFIXES = (4, 5, 6, 7)
#: A beginning enters the lexicon with this many toxic documents and this log-odds, at least.
MIN_DOCS, MIN_ODDS = 4, 2.5
#: Classes of words that a worker keeps (about 8 MB), and the longest kept.
WORDS_KEPT, WORD_BYTES = 50_000, 40
#: Entries of the learned lexicon, at most; the strongest stay.
LEXICON = 5_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
#: General English words of the grammar; the insults here only matter where the labels have none.
GRAMMAR = {
    THREAT: "kill hurt destroy beat punish attack murder strangle shoot stab",
    TARGET: "you your yours yourself u ur he him his she her they them their those these everyone",
    NEGATION: "not no never isn wasn aren weren don doesn didn without neither nor nobody",
    REPORT: "said says say called calls wrote writes claimed claims quoted quote reported reports according heard told",
}
CLASS_OF = {w: c for c, ws in GRAMMAR.items() for w in ws.split()}
SEED_INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting".split()

_TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n]")
_WORD = re.compile(r"[^\W\d_]+")


def compose() -> tuple[list[list[int]], list[int]]:
    """(next state by state and class, context by state) of the clause machine.

    Each part is a transducer with states "not seen" and "seen" in this clause; the composed
    machine's states are the pairs, triples, ... of theirs, numbered as bits.
    """
    parts = (INSULT, THREAT, TARGET, NEGATION, REPORT)
    states = list(product((0, 1), repeat=len(parts)))
    number = {s: i for i, s in enumerate(states)}
    go = []
    for s in states:
        row = [number[s]] * 7
        for k, c in enumerate(parts):
            row[c] = number[s[:k] + (1,) + s[k + 1 :]]
        row[STOP] = 0
        go.append(row)
    context = []
    for insult, threat, target, negation, report in states:
        if not (insult or (threat and target)):
            context.append(-1)
        elif report:
            context.append(3)
        elif negation:
            context.append(2)
        else:
            context.append(1 if target else 0)
    return go, context


GO, CONTEXT = compose()
CONTEXTS = 4
#: Features: score of the clauses in each context, clauses matched, share of the text's clauses.
FEATURES = CONTEXTS + 2


class Grammar:
    """The composed machine with a learned lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            own = CLASS_OF.get(word, OTHER)
            weight = max((self.lexicon.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k), default=0.0)
            weight = max(weight, self.lexicon.get(word + "$", 0.0))
            got = (INSULT, weight) if weight > 0 else (own, 1.0 if own == THREAT else 0.0)
            if len(word) <= WORD_BYTES:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[word] = got
        return got

    def features(self, text: str) -> list[float]:
        score = [0.0] * CONTEXTS
        clauses = matched = 0
        state, weight, known = 0, 0.0, self.known
        for token in [*_TOKEN.findall(text.lower()), "."]:
            got = known.get(token)
            if got is None:
                if token in ".,;:!?\n":
                    clauses += 1
                    if state:
                        where = CONTEXT[state]
                        if where >= 0:
                            score[where] += weight
                            matched += 1
                        state, weight = 0, 0.0
                    continue
                got = self.classify(token)
            kind, w = got
            if kind:
                state = GO[state][kind]
                weight += w
        return [*(math.log1p(s) for s in score), math.log1p(matched), matched / max(1, clauses)]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class Model:
    """Lexicon and logistic weights; small and of bounded size, so tasks get it whole."""

    def __init__(self, lexicon: dict[str, float], bias: float, weights: list[float]):
        self.lexicon, self.bias, self.weights = lexicon, bias, weights
        self._grammar: Grammar | None = None

    def score(self, text: str) -> float:
        if self._grammar is None:
            self._grammar = Grammar(self.lexicon)
        return sigmoid(self.bias + sum(w * x for w, x in zip(self.weights, self._grammar.features(text), strict=True)))

    def to_json(self) -> str:
        return json.dumps({"lexicon": self.lexicon, "bias": self.bias, "weights": self.weights})


def _beginnings(words: set[str]) -> set[str]:
    out = {w + "$" for w in words}
    for w in words:
        for k in PREFIXES:
            if len(w) >= k:
                out.add(w[:k])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Newton's method with a ridge on the weights."""
    if not len(y):
        return -2.0, [1.0] * (x.shape[1] if x.ndim == 2 else FEATURES)
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        hess = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), [float(v) for v in w[1:]]


def held_out(doc_id):
    """Rows that the labels are never taken from: crc32 of doc_id as text is divisible by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from at most ``rows`` labelled documents that aren't held out.

    Half of them give the lexicon, the other half the weights, so that these see the lexicon
    at work on other documents. Without usable labels a small general lexicon takes over.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded table from here on
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = Scratch(docs.sparkSession, "toxicity").save(sample, "sample")  # three passes read it
    first = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0

    def counted(df: DataFrame, only: set[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: Counter[str] = Counter()
            n = 0
            for batch in batches:
                for t in texts(batch.column(1)):
                    have = _beginnings(set(_WORD.findall(t.decode().lower())))
                    count.update(have if only is None else have & only)
                    n += 1
            count["#"] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["f", "n"])

        return df.select("doc_id", "text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    toxic = counted(sample.where(first & (F.col("toxic") == 1)), None).where(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "f").limit(200_000).collect()
    hot = {r["f"]: r["n"] for r in toxic}
    clean = {r["f"]: r["n"] for r in counted(sample.where(first & (F.col("toxic") == 0)), set(hot)).collect()}
    a, b = hot.pop("#", 0), clean.pop("#", 0)
    odds = {f: math.log((n + 0.5) / (a + 1)) - math.log((clean.get(f, 0) + 0.5) / (b + 1)) for f, n in hot.items()}
    strong = sorted((f for f, o in odds.items() if o >= MIN_ODDS), key=lambda f: (-odds[f], f))[:LEXICON]
    lexicon = {f: round(odds[f], 6) for f in strong} or {w + "$": 4.0 for w in SEED_INSULTS}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon)
        for batch in batches:
            x = [g.features(t.decode()) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = sample.where(~first).select("text", "toxic").mapInArrow(measured, "toxic int, x array<double>").collect()
    x = np.array(sorted([*r["x"], float(r["toxic"])] for r in seen)).reshape(len(seen), FEATURES + 1)
    bias, weights = _logistic(x[:, :-1], x[:, -1])
    return Model(lexicon, bias, weights)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``: probability that the text is toxic. Null texts are empty texts.

    Only the text goes to Python. ``name`` must not clash with a column of ``docs``.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for column in columns:
            yield pa.array([m.score(t.decode()) for t in texts(column)], pa.float64())
        release()

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have the score of a text without clauses; very long texts are read
    whole; repeated rows and rows that share a doc_id are scored each; a row without doc_id
    isn't labelled; an empty table gives an empty one, and without labels a small general
    lexicon stands in. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(own, fit(own, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; columns as they were, whatever their names. Odd rows as in ``toxicity``."""
    name = fresh("toxicity_score", docs.columns)
    return score(docs, fit(docs, labels, rows), name).where(F.col(name) < threshold).select(docs.columns)
