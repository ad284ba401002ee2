"""Hard negatives: for an anchor and one of its nearest rows of the same label, the rows of other labels that score nearly as high.

Vectors are made whole numbers, floor(``SCALE`` x).  Inner products are computed in a residue number system: components modulo several
primes, in float32, with sums short enough to stay exact; Chinese remaindering by balanced mixed radix gives the signed whole
number back.  The primes are as many as the largest squared length asks for, since no product is larger.

Anchors are a stated set of rows.  All rows are dealt to blocks by a hash of their id, whatever their label, and every
block of rows meets every block of anchors in a task of its own; a task keeps the best few rows of an anchor, and a
window per anchor, then per anchor and positive, selects among the tasks.  Two rounds are needed: the scores of the positives
bound those of the negatives.

Defined cases: rows with a NULL id, label or vector, or with a component that is NULL, NaN or infinite, take no part; shorter
vectors are filled up with zeros; of rows with equal ids the one with the largest label, then vector counts; ties go to the smaller
id; an empty table gives no rows.  Inner products that may have more than ``BITS`` bits raise
an error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.llm.tables import stored
from tidecrew.plans.combine import spread_out

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative scores at least this many hundredths of the positive, and no more than the positive.
LEAST_PERCENT = 80
# Rows and anchors that a task sees at most, about, and the part of them multiplied at a time.
ROWS = 1 << 16
ANCHORS = 1 << 14
ROWS_AT_ONCE = 4_096
ANCHORS_AT_ONCE = 512
# Residues lie between -p / 2 and p / 2; this many products of two add up exactly in float32 for the primes used.
LARGEST_PRIME = 1_021
TERMS = (1 << 24) // (LARGEST_PRIME // 2) ** 2
# Of an inner product, so that a hundred times it fits a signed 64-bit number.
BITS = 56


def primes_for(bound: int) -> list[int]:
    """The largest primes up to ``LARGEST_PRIME`` whose product tells all whole numbers of at most ``bound`` in size apart."""
    found, product = [], 1
    for p in range(LARGEST_PRIME, 2, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
    return found


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of smallest size, for an odd prime."""
    x = np.mod(x, p)
    return np.where(x > p // 2, x - p, x)


class Residues(NamedTuple):
    """A matrix as float32 residues, one matrix per prime."""

    primes: list[int]
    parts: list[np.ndarray]


def residues(matrix: np.ndarray, primes: list[int]) -> Residues:
    """``matrix`` holds whole numbers as float64, of any size: the remainder of a division is exact."""
    return Residues(primes, [balanced(np.fmod(matrix, p), p).astype(np.float32) for p in primes])


def products(a: Residues, b: Residues) -> np.ndarray:
    """The exact inner products of the rows of two matrices, as int64."""
    digits: list[np.ndarray] = []
    value, radix = None, 1
    for k, p in enumerate(a.primes):
        x, y = a.parts[k], b.parts[k]
        total = np.zeros((len(x), len(y)), dtype=np.int64)
        for at in range(0, x.shape[1], TERMS):
            total += (x[:, at : at + TERMS] @ y[:, at : at + TERMS].T).astype(np.int64)
        for q, digit in zip(a.primes, digits, strict=False):
            total = np.mod(total - digit, p) * pow(q, -1, p)
        digit = balanced(total, p)
        digits.append(digit)
        value = digit if value is None else value + digit * radix
        radix *= p
    return np.zeros((len(a.parts[0]), len(b.parts[0])), dtype=np.int64) if value is None else value


def whole(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(``SCALE`` x) as float64, rows filled up with zeros."""
    flat = vectors.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    values = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _least(dtype=np.int64) -> int:
    return np.iinfo(dtype).min


def best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, column) of the n highest allowed scores of every row, the first among equals; missing ones have the least number."""
    left = np.where(allowed, scores, _least())
    value, column = np.full((len(scores), n), _least()), np.zeros((len(scores), n), dtype=np.int64)
    if scores.shape[1]:
        rows = np.arange(len(scores))
        for k in range(n):
            column[:, k] = left.argmax(axis=1)
            value[:, k] = left[rows, column[:, k]]
            left[rows, column[:, k]] = _least()
            if (value[:, k] == _least()).all():
                break
    return value, column


class _Kept:
    """The best rows of every anchor so far.  Rows come in order of their id, so a stable sort leaves ties to the smaller one."""

    def __init__(self, anchors: int, n: int):
        self.n = n
        self.value, self.id = np.full((anchors, n), _least()), np.zeros((anchors, n), dtype=np.int64)

    def add(self, value: np.ndarray, ids: np.ndarray) -> None:
        value, ids = np.concatenate([self.value, value], axis=1), np.concatenate([self.id, ids], axis=1)
        order = np.argsort(-np.maximum(value, _least() + 1), axis=1, kind="stable")[:, : self.n]
        self.value, self.id = np.take_along_axis(value, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _matrices(rows: pa.Table, primes: list[int], width: int) -> tuple[np.ndarray, np.ndarray, Residues]:
    """(ids, labels, residues) in order of the id."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    found = residues(whole(rows.column("vector"), width)[order], primes)
    return ids[order], rows.column("label").to_numpy()[order], found


def _part(r: Residues, some: slice) -> Residues:
    return Residues(r.primes, [x[some] for x in r.parts])


def _slices(n: int, size: int) -> list[slice]:
    return [slice(at, min(at + size, n)) for at in range(0, n, size)]


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & sound)
    kept = stored(kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vector")), "vectors")
    n, distinct = kept.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if n == distinct:
        return kept
    return stored(kept.groupBy("id").agg(F.max(F.struct("label", "vector")).alias("m")).select("id", "m.label", "m.vector"), "vectors")


class Layout(NamedTuple):
    """The primes, the longest vector, and the numbers of blocks of rows and of anchors."""

    primes: list[int]
    width: int
    rows: int
    anchors: int


def layout(rows: DataFrame, anchors: DataFrame) -> Layout:
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    n, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(squares)).first()
    bound = int((largest or 0.0) * (1 + 1e-9)) + 1 if math.isfinite(largest or 0.0) else 1 << BITS
    if bound >= 1 << BITS:
        raise ValueError(f"inner products may have more than {BITS} bits")
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // ROWS), min(-(-n // 1024), tasks), 1)
    return Layout(primes_for(bound), width or 0, blocks, max(1, -(-anchors.count() // ANCHORS)))


def met(rows: DataFrame, anchors: DataFrame, plan: Layout, run, schema: str) -> DataFrame:
    """``run`` over every block of rows with every block of anchors."""

    def dealt(df: DataFrame, own: Column, others: int, place) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_other")
        spread = df.select("*", own.alias("_own"), other)
        return spread_out(spread.withColumn("task", place(F.col("_own"), F.col("_other"))).drop("_own", "_other"), "task")

    left = dealt(rows, F.pmod(F.xxhash64("id"), F.lit(plan.rows)), plan.anchors, lambda own, other: own * plan.anchors + other)
    right = dealt(anchors, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(plan.anchors)), plan.rows, lambda own, other: other * plan.anchors + own)
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(run, schema)


def positives(rows: DataFrame, anchors: DataFrame, plan: Layout, n: int = POSITIVES) -> DataFrame:
    """(anchor, positive, score): the n highest other rows of an anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, matrix = _matrices(left, plan.primes, plan.width)
        names, own, queries = _matrices(right, plan.primes, plan.width)
        kept = _Kept(len(names), n)
        # Only rows of the same label are multiplied.
        for label in np.unique(own):
            mine, theirs = np.flatnonzero(own == label), np.flatnonzero(labels == label)
            for a in _slices(len(mine), ANCHORS_AT_ONCE):
                some = mine[a]
                chosen = _Kept(len(some), n)
                for b in _slices(len(theirs), ROWS_AT_ONCE):
                    others = theirs[b]
                    scores = products(Residues(plan.primes, [x[some] for x in queries.parts]), Residues(plan.primes, [x[others] for x in matrix.parts]))
                    value, column = best(scores, names[some][:, None] != ids[others][None, :], n)
                    chosen.add(value, ids[others][column])
                kept.value[some], kept.id[some] = chosen.value, chosen.id
        at, k = np.nonzero(kept.value != _least())
        return pa.table({"anchor": names[at], "positive": kept.id[at, k], "score": kept.value[at, k]})

    found = met(rows, anchors, plan, run, "anchor long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "positive")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``is_anchor`` is a condition on the column ``id``; ``label`` defaults to the column of that name.
    """
    known = prepared(rows, id_col, vector_col, F.col("label") if label is None else label)
    anchors = known.filter(is_anchor)
    plan = layout(known, anchors)
    pairs = stored(positives(known, anchors, plan, n_positives), "positives")
    lists = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("score", "positive")), asc=False).alias("pairs"))
    asked = stored(anchors.join(lists, F.col("id") == F.col("anchor")).select("id", "label", "vector", "pairs"), "asked")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, matrix = _matrices(left, plan.primes, plan.width)
        names, own, queries = _matrices(right, plan.primes, plan.width)
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        limits, partner = np.full((len(names), n_positives), _least()), np.zeros((len(names), n_positives), dtype=np.int64)
        for i, pair in enumerate(right.column("pairs").take(pa.array(order)).to_pylist()):
            for k, p in enumerate(pair):
                limits[i, k], partner[i, k] = p["score"], p["positive"]
        out = []
        for a in _slices(len(names), ANCHORS_AT_ONCE):
            kept = [_Kept(a.stop - a.start, n_negatives) for _ in range(n_positives)]
            mine = _part(queries, a)
            for b in _slices(len(ids), ROWS_AT_ONCE):
                scores = products(mine, _part(matrix, b))
                other = own[a][:, None] != labels[b][None, :]
                for k in range(n_positives):
                    limit = limits[a, k][:, None]
                    near = other & (limit != _least()) & (scores <= limit) & (100 * scores >= LEAST_PERCENT * limit)
                    if near.any():
                        value, column = best(scores, near, n_negatives)
                        kept[k].add(value, ids[b][column])
            for k, one in enumerate(kept):
                at, place = np.nonzero(one.value != _least())
                out.append((names[a][at], partner[a][at, k], one.id[at, place], limits[a][at, k], one.value[at, place]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table(dict(zip(["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"], columns, strict=True)))

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = met(known, asked, plan, run, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
