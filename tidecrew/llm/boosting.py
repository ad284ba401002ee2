"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled rows, on histograms of at most 32 bins per statistic, with second-order gains.  For
statistics named as monotone, a split is taken only if it moves the score the right way, and the bound between the
two sides is handed down, so the whole forest is monotone in them.  The finished trees are flattened into numpy
arrays of nodes, and scoring walks all documents of a batch down one level at a time.

Defined cases: a NULL or empty text has no words and fails the base rules; with fewer than two classes in the labels
every document that passes the base rules is kept; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import COUNTS, FEATURES, batches_measured, with_features
from tidecrew.llm.samples import labelled

# Labelled rows the trees are fitted on at most.
SAMPLE = 20_000
# Direction of quality in a statistic: more of these is never better.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "exclamation_ratio": -1, "bar_ratio": -1, "echo_ratio": -1}
KEEP_FROM = 0.5


class Forest(NamedTuple):
    """Flattened trees: node k goes left if its feature is at most the threshold; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least: int = 10,
) -> Forest:
    """Boosted trees for the log-odds of ``y``; ``monotone`` gives the sign of the wanted slope by feature."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else column for column in x.T]
    codes = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    scores = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f, edges in enumerate(cuts):
                size = len(edges) + 1
                code = codes[rows, f]
                gl = np.cumsum(np.bincount(code, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                wl = np.clip(-gl / (hl + ridge), low, high)
                wr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                fair = (nl >= least) & (len(rows) - nl >= least) & (monotone.get(f, 0) * (wr - wl) >= 0)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + ridge) * wr**2)
                gain = np.where(fair, gain, -np.inf)
                if len(gain) and (best is None or gain.max() > best[0]):
                    k = int(gain.argmax())
                    best = (gain[k], f, k, wl[k], wr[k])
        own = weight(gs, hs, low, high)
        if best is None or best[0] <= -(gs * own + 0.5 * (hs + ridge) * own**2) + 1e-6:
            at = leaf(rate * own)
            scores[rows] += rate * own
            return at
        _, f, k, wl, wr = best
        at = leaf(0.0)
        goes_left = codes[rows, f] <= k
        middle, sign = (wl + wr) / 2, monotone.get(f, 0)
        ends = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]
        left = grow(rows[goes_left], g, h, level + 1, *ends[0])
        right = grow(rows[~goes_left], g, h, level + 1, *ends[1])
        nodes[at] = [f, float(cuts[f][k]), left, right, 0.0]
        return at

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-scores))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    flat = np.array(nodes).reshape(-1, 5)
    whole = flat[:, [0, 2, 3]].astype(np.int64)
    return Forest(whole[:, 0], flat[:, 1], whole[:, 1], whole[:, 2], flat[:, 4], np.array(roots, dtype=np.int64), base, depth)


def score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Probability of the positive class for every row of ``x``."""
    total = np.full(len(x), forest.base)
    rows = np.arange(len(x))
    for root in forest.roots:
        at = np.full(len(x), root)
        for _ in range(forest.depth):
            at = np.where(x[rows, forest.feature[at]] <= forest.threshold[at], forest.left[at], forest.right[at])
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, allowed: F.Column | None = None) -> Forest:
    """The forest for ``labels.quality``; features are computed in tasks, and only they come to the driver."""
    rows = labelled(docs, labels, "quality", sample, F.lit(True) if allowed is None else allowed)
    measured = with_features(rows, "text", "doc_id", "label").toArrow().to_pydict()
    order = np.argsort(np.array(measured["doc_id"], dtype=np.int64), kind="stable")
    x = np.array(measured["features"], dtype=float).reshape(-1, len(FEATURES))[order]
    y = np.array(measured["label"], dtype=float)[order]
    return fit(x, y, {FEATURES.index(name): sign for name, sign in MONOTONE.items()})


def judged(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """(id, counts, base_failed, quality, kept) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, features in batches_measured(batches, 1):
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < 20) | (100 * repeat > 30 * n)
            quality = score(forest, features)
            columns = [pa.array(column) for column in (*counts.T, failed, quality, ~failed & (quality >= keep_from))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *COUNTS, "base_failed", "quality", "kept"])

    schema = ", ".join([f"id {kind}", *[f"{c} long" for c in COUNTS], "base_failed boolean, quality double, kept boolean"])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
