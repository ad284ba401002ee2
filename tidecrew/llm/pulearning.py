"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; the unlabelled side is a sample of all documents.  No
negative label is used.  The share of positives among the unlabelled is estimated first (best bin: the smallest ratio
of the two score distributions' upper tails), then a logistic model over binned document statistics minimises the
non-negative unbiased risk: the negative part of the risk, which is estimated by a difference, may not fall below
zero, and where it would, its gradient is undone.  Scores become probabilities by a calibration on positives and unlabelled rows
that the fit did not see.

Defined cases: NULL and empty texts are scored like any other, from zero statistics; without positives the score is
0.5 for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import FEATURES, batches_measured, with_features
from tidecrew.llm.neighbours import isotonic
from tidecrew.llm.samples import labelled, sample_of

# Labelled positives, and unlabelled documents, the model is fitted on at most.
POSITIVES = 8_192
UNLABELLED = 8_192
BINS = 16


class Model(NamedTuple):
    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float
    steps: np.ndarray  # of the calibration: scores of the linear model
    levels: np.ndarray  # and probabilities


def one_hot(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Each statistic as one active bin; bins of all statistics side by side."""
    parts = []
    for edges, column in zip(cuts, x.T, strict=True):
        part = np.zeros((len(x), len(edges) + 1))
        part[np.arange(len(x)), np.searchsorted(edges, column, "left")] = 1.0
        parts.append(part)
    return np.concatenate(parts, axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _told_apart(p: np.ndarray, u: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Weights, bias last, of a logistic model that tells positives from unlabelled."""
    w, adam = np.zeros(p.shape[1]), _Adam(p.shape[1], 0.1)
    for _ in range(steps):
        up, uu = _sigmoid(p @ w), _sigmoid(u @ w)
        w = w + adam.step((p.T @ (up - 1)) / len(p) + (u.T @ uu) / len(u) + ridge * w)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from held-out halves of both samples."""
    w = _told_apart(p[::2], u[::2])
    held_p, held_u = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(held_p)) + 1 / np.sqrt(len(held_u)))
    points = np.unique(held_p)
    top_p = 1 - np.searchsorted(held_p, points, "left") / len(held_p)
    top_u = 1 - np.searchsorted(held_u, points, "left") / len(held_u)
    # The bound is loosest where few positives are left, so the best bin is one with many.
    best = np.argmin((top_u + slack) / top_p)
    return float(np.clip(top_u[best] / top_p[best], 0.05, 0.98))


def calibrated(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps and levels of the probability of a positive, by scores of held-out positives and unlabelled rows.

    An isotonic fit tells positives from unlabelled rows; prior times the ratio of the two densities is the probability.
    """
    steps, share = isotonic(np.concatenate([zp, zu]), np.concatenate([np.ones(len(zp)), np.zeros(len(zu))]))
    ratio = share / np.maximum(1 - share, 1e-9) * (len(zu) / len(zp))
    return steps, np.clip(prior * ratio, 0.0, 1.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, most: int = 4_000, ridge: float = 1e-4, settled: float = 1e-6) -> Model:
    """The model; every fourth row of both sides is kept for the calibration.  Steps end when the risk changes no more."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in unlabelled.T]
    plain = np.array([0.0, 1.0])
    if not len(positive):
        return Model(cuts, np.zeros(sum(len(c) + 1 for c in cuts)), 0.0, 0.5, plain, np.array([0.5, 0.5]))
    p, u = one_hot(cuts, positive), one_hot(cuts, unlabelled)
    p, u = np.column_stack([p, np.ones(len(p))]), np.column_stack([u, np.ones(len(u))])
    enough = min(len(p), len(u)) >= 20
    prior = class_prior(p, u) if enough else 0.5
    if enough:
        apart = [np.arange(len(x)) % 4 == 3 for x in (p, u)]
        held, p, u = (p[apart[0]], u[apart[1]]), p[~apart[0]], u[~apart[1]]
    w, adam = np.zeros(p.shape[1]), _Adam(p.shape[1], 0.05)
    risks: list[float] = []
    for _ in range(most):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # Logistic losses: positives as positive, positives as negative, unlabelled as negative.
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        towards = prior * (p.T @ (sp - 1)) / len(p)
        away = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        w = w + adam.step((towards + away if negative >= 0 else -away) + ridge * w)
        risks.append(prior * np.logaddexp(0, -zp).mean() + max(0.0, negative))
        if len(risks) >= 200 and abs(np.mean(risks[-100:]) - np.mean(risks[-200:-100])) < settled:
            break
    model = Model(cuts, w[:-1], float(w[-1]), prior, np.array([-40.0, 40.0]), _sigmoid(np.array([-40.0, 40.0])))
    if not enough:
        z = np.linspace(-8, 8, 65)
        return model._replace(steps=z, levels=_sigmoid(z))
    steps, levels = calibrated(held[0] @ w, held[1] @ w, prior)
    return model._replace(steps=steps, levels=levels)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities of good quality; a small share of the linear score keeps the order within a level."""
    z = one_hot(model.cuts, x) @ model.weights + model.bias
    return 0.99 * np.interp(z, model.steps, model.levels) + 0.01 * _sigmoid(z)


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model, from labels of rows that are ``allowed``; only features come to the driver."""

    def features(rows: DataFrame) -> np.ndarray:
        found = with_features(rows, "text", "doc_id").toArrow().to_pydict()
        order = np.argsort(np.array(found["doc_id"], dtype=np.int64), kind="stable")
        return np.array(found["features"], dtype=float).reshape(-1, len(FEATURES))[order]

    good = labels.filter("quality = 1")
    trusted = labelled(docs, good, "quality", positives, allowed)
    chosen = F.broadcast(sample_of(docs.select("doc_id").distinct(), unlabelled, seed=1))
    return fit(features(trusted), features(docs.select("doc_id", "text").join(chosen, "doc_id")))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, features in batches_measured(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, features))], ["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
