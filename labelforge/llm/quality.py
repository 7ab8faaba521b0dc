"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good, unlabelled rows are web text of any quality. A class prior is estimated from how the scores of
a positive-against-unlabelled model spread over held-back positives and over all rows, then an additive piecewise-linear model minimises the non-negative
unbiased risk ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with logistic loss, so that its output is a probability.

Defined cases: a null text counts as the empty text and gets a score like any other; ids labelled both ways are no positives; without
any positive every score is 0; repeated rows are scored each on its own; an empty table gives an empty result; other columns are
never read.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, map_texts

#: Rows of each kind that the fit uses at most, the smallest by a hash of the id.
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 8_000
KNOTS = 6
STEPS = 400
RATE = 0.05
DECAY = 1e-4

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
WIDTH = len(_PUNCTUATION) + 14


def features(text: str | None) -> np.ndarray:
    """Shares of characters, words and lines that tell prose from junk; all zero for an empty text."""
    out = np.zeros(WIDTH)
    raw = (text or "").encode()
    if not raw:
        return out
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    out[:len(_PUNCTUATION)] = n[_PUNCTUATION] / size
    words = raw.split()
    lines = raw.split(b"\n")
    upper, lower = n[65:91].sum(), n[97:123].sum()
    k = len(words)
    distinct = len(set(words))
    out[len(_PUNCTUATION):] = (
        upper / max(1, upper + lower), lower / size, n[48:58].sum() / size, n[128:].sum() / size, (n[9:14].sum() + n[32]) / size, n[_PUNCTUATION].sum() / size,
        distinct / max(1, k), distinct / max(1.0, k ** 0.7), sum(map(eq, words, words[1:])) / max(1, k), size / max(1, k) / 20, len(set(lines)) / len(lines),
        np.log1p(k) / 10, np.log1p(size / len(lines)) / 10, sum(len(w) < 4 for w in words) / max(1, k))
    return out


@dataclass
class QualityModel:
    prior: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Hinges at the knots of every feature, scaled."""
        return (np.maximum(0.0, x[:, None, :] - self.knots[None]).reshape(len(x), -1)) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.prior:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights + self.bias, -40, 40)))


def _descend(gradient, width: int) -> tuple[np.ndarray, float]:
    """Adam over weights and bias; ``gradient(w)`` takes and gives them in one vector."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], w[-1]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Thresholds at which the tails of positives and unlabelled rows are compared: these shares of the held-back positives lie below them.
TAILS = np.linspace(0.0, 0.5, 26)


def ranking(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights that tell positives from unlabelled rows, learned from half of the positives, and the scores of the other half."""
    p = p[np.random.default_rng(0).permutation(len(p))]
    half = len(p) // 2

    def gradient(w):
        gp = _sigmoid(p[:half] @ w[:-1] + w[-1]) - 1
        gu = _sigmoid(u @ w[:-1] + w[-1])
        return np.append(p[:half].T @ gp / half + u.T @ gu / len(u) + DECAY * w[:-1], gp.mean() + gu.mean())
    w, _ = _descend(gradient, p.shape[1])
    return w, p[half:] @ w


def prior_of(held: np.ndarray, cuts: np.ndarray, tails: np.ndarray) -> float:
    """Share of positives among all unlabelled rows: the least ratio of their tails (shares at or above each cut) to those of the held-back
    positives; only tails that hold half of the positives or more, so that a thin tail cannot win by chance."""
    return float(np.clip(min(t / (held >= c).mean() for c, t in zip(cuts, tails)), 0.02, 0.98))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the unbiased risk; the loss is logistic and the last weight is the bias."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk (with weight decay); where its negative part falls below zero, that part alone is climbed back."""
    sp, su = _sigmoid(p @ w[:-1] + w[-1]), _sigmoid(u @ w[:-1] + w[-1])
    gn = np.append(u.T @ su / len(u) - prior * (p.T @ sp) / len(p), su.mean() - prior * sp.mean())
    if risk(w, p, u, prior)[1] < 0:
        return -gn
    gp = prior * np.append(p.T @ (sp - 1) / len(p), (sp - 1).mean())
    return gp + gn + np.append(DECAY * w[:-1], 0.0)


def fit(positives: np.ndarray, unlabelled: np.ndarray, tails_of=None) -> QualityModel:
    """Minimise the non-negative risk on sampled rows. ``tails_of(model, weights, cuts)`` gives the shares of all unlabelled rows that score at or
    above each cut; without it the sample's are taken."""
    if len(positives) < 2 or len(unlabelled) < 2:
        return QualityModel()
    both = np.concatenate((positives, unlabelled))
    knots = np.quantile(both, np.linspace(0, 0.98, KNOTS), axis=0)
    model = QualityModel(0.5, knots, np.ones(KNOTS * WIDTH))
    model.scale = np.maximum(model.basis(both).std(axis=0), 1e-3)
    p, u = model.basis(positives), model.basis(unlabelled)
    w, held = ranking(p, u)
    cuts = np.quantile(held, TAILS)
    tails = tails_of(model, w, cuts) if tails_of else np.array([(u @ w >= c).mean() for c in cuts])
    model.prior = prior_of(held, cuts, tails)
    model.weights, model.bias = _descend(lambda w: risk_gradient(w, p, u, model.prior), p.shape[1])
    return model


def tails(df: DataFrame, model: QualityModel, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of all rows that score at or above each cut. A map and one small aggregation."""
    shared = df.sparkSession.sparkContext.broadcast((model, weights, cuts))

    def make():
        model, w, cuts = shared.value

        def step(b):
            z = model.basis(np.array([features(t) for t in b.column(0).to_pylist()]).reshape(-1, WIDTH)) @ w
            return batch(k=pa.array(np.arange(len(cuts) + 1), pa.int32()), n=pa.array([*((z >= c).sum() for c in cuts), len(z)], pa.int64()))
        return step
    counts = map_texts(df.select("text"), ["text"], "text", make, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    n = {r["k"]: r["n"] for r in counts.collect()}  # one row per cut
    return np.array([n[k] for k in range(len(cuts))]) / n[len(cuts)]


def _feature_rows(df: DataFrame, most: int) -> np.ndarray:
    def make():
        def step(b):
            return batch(f=pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())))
        return step
    rows = map_texts(df.select("text").limit(most), ["text"], "text", make, "f array<double>").toPandas()["f"]
    return np.array(rows.tolist(), float).reshape(-1, WIDTH)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Fit on at most ``max_positives`` labelled and ``max_unlabelled`` other rows, chosen by a hash of the id; their features (a few
    hundred bytes a row) reach the driver, texts do not. The class prior is estimated over all rows."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("a"), F.max(label_col).alias("b")).filter("a = 1 and b = 1")
    by = F.xxhash64(F.col("id").cast("string"))
    chosen = good.select("id").orderBy(by, "id").limit(max_positives)
    others = docs.select("id").distinct().orderBy(by, "id").limit(max_unlabelled)
    # both sides of at most the documented number of ids
    return fit(_feature_rows(docs.join(F.broadcast(chosen), "id"), max_positives), _feature_rows(docs.join(F.broadcast(others), "id"), max_unlabelled),
               lambda model, weights, cuts: tails(docs, model, weights, cuts))


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``score``, the probability of being good. A map without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(b):
            s = model.score(np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, WIDTH))
            return batch(id=b.column(0), score=pa.array(s, pa.float64()))
        return step
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(named, ["id", "text"], "text", make, f"id {kind}, score double").withColumnRenamed("id", id_col)
