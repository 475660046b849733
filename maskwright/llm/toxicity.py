"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is linear over word features: the word, and its first and last
three to seven letters, each present or not in a text.  It sees confirmed toxic
texts (P) and unlabelled texts (U), never a text confirmed as harmless.  With
the share of toxic texts pi, the risk is

    pi * R(P, +) + max(0, R(U, -) - pi * R(P, -))

for the logistic loss; where the bracket falls below zero (the classifier fits
toxic texts in U as harmless ones), the step goes the other way, as
non-negative PU learning asks.  The share pi is given, or estimated from P and
U.  Training is plain numpy in one task over a bounded sample: at most
``POSITIVES`` toxic and ``UNLABELLED`` rows of any kind, the least by a hash of
id and text, of longer texts ``LONGEST`` characters; the ``FEATURES`` features
that differ most between P and U are kept.  Every document is scored, whole; a
word's weight is looked up once per process.

Defined cases: null text counts as empty and gets the score of a text without
features; very long texts are scored whole, in memory that grows with their
different words; repeated label rows count once, toxic if one says so; labels of
a null id count for nothing; rows of a null or repeated id are learned and scored
each by its own text; without toxic labels, or with empty tables, every score is
that of a text without features, about 0; extra columns aren't read, whatever
their names.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import crc_mod, slices

POSITIVES, UNLABELLED, LONGEST = 1500, 4500, 20_000
FEATURES = 1500
#: Standard errors by which a feature's share in P exceeds that in U, so that few of the many features pass by chance.
LEAST = 4.5
WORDS = 200_000
#: Share of P that a rule must pick to bound the prior.
RULE = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, and its beginnings and endings of three to seven letters."""
    n = len(word)
    return [f"={word}", *[f"^{word[:k]}" for k in range(3, min(8, n + 1))], *[f"{word[-k:]}$" for k in range(3, min(8, n + 1))]]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)  # by feature
    bias: float = -20.0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def present(self, text: str) -> set[str]:
        """The model's features that a text has."""
        found: set[str] = set()
        for word in words_of(text):
            hit = self.known.get(word)
            if hit is None:
                hit = tuple(x for x in features_of(word) if x in self.weights)
                if len(self.known) >= WORDS:
                    self.known.clear()
                self.known[word] = hit
            if hit:
                found.update(hit)
        return found

    def score(self, text: str) -> float:
        # sorted: floating-point sums must not hang on the order of a set
        total = self.bias + sum(map(self.weights.__getitem__, sorted(self.present(text))))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def select_features(positive: list[str], unlabelled: list[str]) -> list[str]:
    """Features with the largest signed chi-like difference between P and U, commonest in P."""

    def features(text: str) -> set[str]:
        own: set[str] = set()
        for w in words_of(text):
            own.update(features_of(w))
        return own

    p: Counter[str] = Counter()
    for t in positive:
        p.update(features(t))
    some = {f for f, c in p.items() if c >= 3}
    u: Counter[str] = Counter()
    for t in unlabelled:
        u.update(some & features(t))
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    ranked = []
    for feature in some:
        c = p[feature]
        a, b = c / n, u[feature] / m
        pooled = (c + u[feature] + 1) / (n + m)
        z = (a - b) / np.sqrt(pooled * (1 / n + 1 / m))
        if z > LEAST:
            ranked.append((-z, feature))
    return [f for _, f in sorted(ranked)[:FEATURES]]


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of toxic texts in U, from the texts' features (matrices of 0 and 1, the telling features first).

    A set of texts that a rule picks holds at least prior * (its share of P) of
    U; so the least ratio of its shares in U and P bounds the prior from above,
    and meets it if the rule picks toxic texts only.  The rules: to hold one of
    the first k features; those that pick less than ``RULE`` of P don't count.
    """
    has_p, has_u = (np.logical_or.accumulate(x > 0, axis=1).mean(0) for x in (p, u))
    fit = has_p >= min(RULE, has_p[-1])
    ratio = (has_u[fit] + 1 / (2 * len(u))) / has_p[fit]
    return float(np.clip(ratio.min(), 1e-4, 0.9))


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of P as toxic, bracket of the harmless class, the step's gradient by weights and bias) of logistic losses.

    With a bracket below zero the gradient is that of the bracket, turned round.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    zp, zu = p @ w + bias, u @ w + bias
    sp, su = sigmoid(zp), sigmoid(zu)
    toxic = prior * np.logaddexp(0, -zp).mean()
    harmless = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # derivatives of the mean losses by the margins
    toxic_p = -prior * (1 - sp) / len(p)
    harmless_u, harmless_p = su / len(u), -prior * sp / len(p)
    gp, gu = (toxic_p + harmless_p, harmless_u) if harmless >= 0 else (-harmless_p, -harmless_u)
    gp, gu = gp.astype(p.dtype), gu.astype(u.dtype)
    return float(toxic), float(harmless), np.append(gp @ p + gu @ u, gp.sum() + gu.sum())


def train(positive: list[str], unlabelled: list[str], prior: float | None = None, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> ToxicityModel:
    """Adam on the non-negative PU risk; ``prior`` None: estimated from the texts."""
    chosen = select_features(positive, unlabelled) if positive and unlabelled else []
    if not chosen:
        return ToxicityModel()
    model = ToxicityModel(dict.fromkeys(chosen, 0.0))
    index = {f: i for i, f in enumerate(chosen)}

    def matrix(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(chosen)), np.float32)
        for i, t in enumerate(texts):
            out[i, [index[f] for f in model.present(t)]] = 1
        return out

    p, u = matrix(positive), matrix(unlabelled)
    prior = estimated_prior(p, u) if prior is None else min(max(prior, 1e-4), 0.9)
    w, bias = np.zeros(len(chosen), np.float32), np.float32(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        gradient = risk(p, u, w, bias, prior)[2] + np.append(decay * w, 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), np.float32(bias - move[-1])
    model.weights = {f: float(x) for f, x in zip(chosen, w, strict=True)}
    model.bias = float(bias)
    model.known.clear()
    return model


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", prior: float | None = None) -> ToxicityModel:
    """A model from the rows of ``labels`` and ``docs`` that the condition on ``id`` admits; labels other than toxic ones aren't needed."""
    marked = labels.select(labels[id_column].alias("id"), labels[label_column].alias("toxic")).where(learnable).where("id is not null and toxic > 0").select("id").distinct()
    spread = F.xxhash64(F.coalesce(docs[id_column].cast("string"), F.lit("")), docs[text_column], F.lit(11))
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), spread.alias("h")).where(learnable).where(F.length("text") > 0)
    # rows are chosen by a hash of id and text, so that a repeated id brings no more rows than it has texts
    positive = texts.join(marked, "id", "left_semi").select("h").distinct().orderBy("h").limit(POSITIVES).select(F.col("h").alias("chosen"), F.lit("p").alias("kind"))
    unlabelled = texts.select("h").distinct().orderBy("h").limit(UNLABELLED).select(F.col("h").alias("chosen"), F.lit("u").alias("kind"))
    picked = texts.join(F.broadcast(positive.union(unlabelled)), F.col("h") == F.col("chosen"))  # at most POSITIVES + UNLABELLED rows are broadcast
    picked = picked.select("kind", "h", F.substring("text", 1, LONGEST).alias("text")).dropDuplicates(["kind", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        model = train([t for k, _, t in found if k == "p"], [t for k, _, t in found if k == "u"], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the bounded sample is fitted in one task, so that the driver holds only the model
    fitted = picked.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else ToxicityModel()


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text", fold: int | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; held_out as crc32(id) mod 5 is ``fold``."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            scores = [own.score(t or "") for t in batch.column(1).to_pylist()]
            held = [None if fold is None else crc_mod(i, 5) == fold for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
