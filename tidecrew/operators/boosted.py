"""Gradient-boosted trees for several classes, grown over all rows of a distributed table.

A round grows one tree per class, level by level.  Per level, every task adds up the gradients and second derivatives of the softmax loss
of its rows, per class, open node, feature and bin; those sums are added up over the tasks, and only they reach the driver,
which picks the splits.  Their number depends on the settings alone, never on the rows.  Sums are kept in whole numbers, so
the trees do not depend on the order in which tasks end.

Rows and columns are sampled by hashes of the row's key and of the round.  The log loss of both sides of the split is added up
with the first level of the next round; growing stops when the test side has not improved for ``patience`` rounds, and the
trees up to its best round are kept.

The derivatives of the rows that are drawn for a round are held while it lasts; they are all that its levels read, so a level goes
through the trees of its own round only.  The rows with their margins are written out every ``stored_every`` rounds, which bounds
what is gone through again for the next round or for a lost executor.  Both are packed arrays of many rows each, handed to the
tasks as they are.  Features of few bins are held as one number, so they are counted and looked up together.  A task of a level goes
through many partitions of the rows, since what it gives back has the size of a level however few its rows are.

Features are whole numbers; a missing one goes where the smallest go.  Labels are 0 .. classes - 1; rows without one take no
part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidecrew.plans.combine import spread_out
from tidecrew.plans.durable import cut, let_go, shared_dir
from tidecrew.plans.running import running_totals

# Gradients and losses are added up as multiples of one in this many.
UNIT = 1 << 24
LEAST_GAIN = 1e-6
LEAST_SHARE = 1e-16

# Rows in a chunk, and for a task of a level; results of as many tasks are added up on the driver at once.
CHUNK = 1 << 15
LEVEL_ROWS = 1 << 21
AT_ONCE = 32
# Combined bins of features that are held as one number; leaves of a tree that fit the bits of a number.
TOGETHER = 1024
LEAVES = 64


class Settings(NamedTuple):
    """Fixed values of the original where it names them."""

    rounds: int = 100
    patience: int = 10
    depth: int = 6
    rate: float = 0.3
    row_share: float = 0.8
    column_share: float = 0.8
    least_weight: float = 3.0
    penalty: float = 1.0
    bins: int = 256
    seed: int = 42
    stored_every: int = 10


class Tree(NamedTuple):
    """Nodes by place: the children of place i are 2 i + 1, for bins below ``cut``, and 2 i + 2.  A leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def bare(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n))


class Boosted(NamedTuple):
    """Trees by round and class; ``edges`` holds the smallest value of every bin of a feature; losses by round."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    classes: int
    trees: list[list[Tree]]
    history: list[tuple[int, float | None, float | None]]


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 up to 1 by key."""
    x = keys.astype(np.uint64) + np.array([seed % (1 << 63)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def columns_of(settings: Settings, turn: int, tree: int, features: int) -> list[int]:
    """The features that a tree may use, in order."""
    order = np.argsort(hashed(np.arange(features) + 1_000_003 * tree, settings.seed + 7_919 * turn), kind="stable")
    return sorted(order[: max(1, int(settings.column_share * features))].tolist())


class Codes(NamedTuple):
    """Features in groups of at most ``TOGETHER`` combined bins, or of one feature: the bins of a group make one number, its code."""

    sizes: tuple[int, ...]
    groups: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(edges: Sequence[np.ndarray]) -> Codes:
        sizes = tuple(max(1, len(edge)) for edge in edges)
        groups: list[list[int]] = []
        for f in sorted(range(len(sizes)), key=lambda f: (sizes[f], f)):
            if groups and int(np.prod([sizes[i] for i in (*groups[-1], f)])) <= TOGETHER:
                groups[-1].append(f)
            else:
                groups.append([f])
        if max(sizes) > np.iinfo(CHUNK_TYPES.codes).max:
            raise ValueError(f"a feature has {max(sizes)} bins")
        return Codes(sizes, tuple(tuple(group) for group in groups))

    def shape(self, group: Sequence[int]) -> tuple[int, ...]:
        return tuple(self.sizes[f] for f in group)

    def coded(self, bins: np.ndarray) -> np.ndarray:
        """A row of codes for every group, from a row of bins for every feature."""
        return np.stack([np.ravel_multi_index(tuple(bins[list(group)]), self.shape(group)) for group in self.groups])

    def width(self, group: Sequence[int]) -> int:
        return int(np.prod(self.shape(group)))

    def bins(self, group: Sequence[int]) -> np.ndarray:
        """The bins of the features of a group by code."""
        return np.stack(np.unravel_index(np.arange(self.width(group)), self.shape(group)))


class Ways(NamedTuple):
    """A tree as bits: ``open`` holds for every group and code the leaves that are not shut off; the first one left is the leaf.

    ``places`` are those of the leaves from left to right.  Nothing here depends on the depth a row goes down to.
    """

    open: list[tuple[int, np.ndarray]]
    places: np.ndarray

    @staticmethod
    def of(tree: Tree, codes: Codes) -> Ways | None:
        leaves: list[int] = []
        shut: list[tuple[int, int, int]] = []

        def walk(at: int) -> None:
            if tree.feature[at] < 0:
                leaves.append(at)
                return
            first = len(leaves)
            walk(2 * at + 1)
            # A row at or above the cut cannot end left of it.
            shut.append((int(tree.feature[at]), int(tree.cut[at]), (1 << len(leaves)) - (1 << first)))
            walk(2 * at + 2)

        walk(0)
        if len(leaves) > LEAVES:
            return None
        found = []
        for number, group in enumerate(codes.groups):
            own = [(group.index(f), cut, mask) for f, cut, mask in shut if f in group]
            if own:
                place, cut, mask = (np.array(x, dtype=kind) for x, kind in zip(zip(*own, strict=True), (np.int64, np.int64, np.uint64), strict=True))
                left = np.where(codes.bins(group)[place] >= cut[:, None], ~mask[:, None], ~np.uint64(0))
                found.append((number, np.bitwise_and.reduce(left, axis=0)))
        return Ways(found, np.array(leaves, dtype=np.int64))

    def leaf(self, coded: np.ndarray) -> np.ndarray:
        """The number of the leaf that every row ends in."""
        if not self.open:
            return np.zeros(coded.shape[1], dtype=np.uint8)
        left = self.open[0][1].take(coded[self.open[0][0]])
        for number, table in self.open[1:]:
            left &= table.take(coded[number])
        return np.bitwise_count(~left & (left - np.uint64(1)))


def places(tree: Tree, coded: np.ndarray, codes: Codes) -> np.ndarray:
    """The leaf that every row ends in, level by level, for trees of any depth."""
    inner = tree.feature >= 0
    at = np.zeros(coded.shape[1], dtype=np.int64)
    if not inner[0]:
        return at
    bins = np.zeros((len(codes.sizes), coded.shape[1]), dtype=np.int64)
    for group, code in zip(codes.groups, coded, strict=True):
        bins[list(group)] = np.unravel_index(code, codes.shape(group))
    # A leaf leads to itself: its left neighbour in ``left`` is its own place, and nothing is right of its cut.
    nodes = np.arange(len(inner))
    left, feature = np.where(inner, 2 * nodes + 1, nodes), np.maximum(tree.feature, 0)
    least = np.where(inner, tree.cut, np.iinfo(np.int64).max)
    rows = np.arange(coded.shape[1])
    for _ in range(int(nodes[inner].max() + 1).bit_length()):
        right = bins[feature.take(at), rows] >= least.take(at)
        at = left.take(at) + right
    return at


def by_leaf(tree: Tree, ways: Ways | None, values: np.ndarray, coded: np.ndarray, codes: Codes) -> np.ndarray:
    """What ``values`` holds for the place of the leaf that every row ends in."""
    return values.take(places(tree, coded, codes)) if ways is None else values[ways.places].take(ways.leaf(coded))


def with_ways(trees: Sequence[Sequence[Tree]], codes: Codes) -> list[list[tuple[Tree, Ways | None]]]:
    return [[(tree, Ways.of(tree, codes)) for tree in turn] for turn in trees]


def raised(margins: np.ndarray, trees: Sequence[Sequence[tuple[Tree, Ways | None]]], coded: np.ndarray, codes: Codes) -> np.ndarray:
    """Margins, a row for every class, after the trees of some rounds."""
    margins, coded = margins.copy(), coded.astype(np.int64)
    for turn in trees:
        for k, (tree, ways) in enumerate(turn):
            margins[k] += by_leaf(tree, ways, tree.value, coded, codes)
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    """Shares of the classes, a row each."""
    powers = np.exp(margins - margins.max(axis=0))
    return powers / powers.sum(axis=0)


def gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by margin, and the share of the true class, the derivatives in whole units."""
    share, rows = softmax(margins), np.arange(len(label))
    truth = share[label, rows]
    second = np.rint(np.maximum(2.0 * share * (1.0 - share), LEAST_SHARE) * UNIT)
    share[label, rows] -= 1.0
    return np.rint(share * UNIT), second, truth


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """The smallest value of every bin.

    A feature of few different values gets a bin for each; another one is cut into bins of about as many rows, by running
    counts over its values.  At most ``bins`` numbers a feature come to the driver.
    """
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("long").alias("value")) for i, f in enumerate(features)]))
    values = rows.select(one.alias("one")).select("one.*").filter("value is not null")
    counts = cut(values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"))
    counted = running_totals(counts, ["feature"], "value", {"up_to": F.col("n")}).join(F.broadcast(sizes), "feature")
    place = F.when(F.col("different") <= bins, F.col("value")).otherwise(F.floor((F.col("up_to") - F.col("n")) * bins / F.col("total")))
    found = counted.groupBy("feature", place.alias("place")).agg(F.min("value").alias("least")).toArrow()
    feature, least = found.column("feature").to_numpy(), found.column("least").to_numpy()
    return [np.sort(least[feature == i]) for i in range(len(features))]


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns side by side, missing values as the smallest number there is."""
    columns = [batch.column(n).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False) for n in names]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """A row of bins for every feature."""
    out = np.zeros(values.T.shape, dtype=np.int64)
    for i, edge in enumerate(edges):
        out[i] = np.maximum(np.searchsorted(edge, values[:, i], "right") - 1, 0)
    return out


class _Chunk(NamedTuple):
    """Some rows, held as one row of a table: keys, sides and labels, codes group by group, and margins class by class."""

    key: np.ndarray
    test: np.ndarray
    label: np.ndarray
    codes: np.ndarray
    margins: np.ndarray


class _Drawn(NamedTuple):
    """Codes and both derivatives, class by class, of the rows of a chunk that a round draws, and (loss, rows) of both sides of all.

    The derivatives are whole units, which single precision holds exactly.
    """

    codes: np.ndarray
    derivatives: np.ndarray
    losses: np.ndarray


CHUNK_TYPES = _Chunk(*map(np.dtype, (np.int64, bool, np.int32, np.uint16, np.float64)))
CHUNK_SCHEMA = ", ".join(f"{name} binary" for name in _Chunk._fields)


class Turn(NamedTuple):
    """A round: its number, and the features that the tree of every class may use."""

    number: int
    columns: list[list[int]]
    codes: Codes
    settings: Settings


def _packed(chunk: _Chunk) -> pa.RecordBatch:
    parts = [np.ascontiguousarray(part, dtype=kind).tobytes() for part, kind in zip(chunk, CHUNK_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in parts], list(_Chunk._fields))


def _chunks(rows: DataFrame, groups: int, classes: int) -> RDD:
    """The rows of :func:`training_rows` as chunks."""

    def chunk(row: tuple) -> _Chunk:
        parts = [np.frombuffer(bytes(part), dtype=kind) for part, kind in zip(row, CHUNK_TYPES, strict=True)]
        return _Chunk(*parts[:3], parts[3].reshape(groups, -1), parts[4].reshape(classes, -1))

    return rows.rdd.map(chunk)


def training_rows(rows: DataFrame, key: str, label: str, test: Column, features: Sequence[str], edges: list[np.ndarray], classes: int) -> DataFrame:
    """Key, side, label, codes and margins of every row, margins at zero, in chunks of about ``CHUNK`` rows."""
    codes = Codes.of(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            *head, coded = (np.concatenate(part, axis=-1) for part in zip(*parts, strict=True))
            return _packed(_Chunk(*head, coded, np.zeros((classes, len(head[0])))))

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            head = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
            held.append((*head, codes.coded(binned(_numbers(batch, features), edges))))
            if sum(len(part[0]) for part in held) >= CHUNK:
                yield chunk(held)
                held = []
        if held:
            yield chunk(held)

    rows = rows.filter(F.col(label).isNotNull())
    head = [F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"), test.alias("test"), F.col(label).cast("int").alias("label")]
    return spread_out(rows.select(*head, *features), "key").mapInArrow(run, CHUNK_SCHEMA)


def _sums(flat: np.ndarray, codes: Codes, classes: int, nodes: int) -> list[list[np.ndarray]]:
    """Parts of ``flat`` by class and group: both derivatives by node and code."""
    widths = [codes.width(group) for group in codes.groups]
    ends = np.cumsum(np.tile(widths, classes) * 2 * nodes)
    parts = [part.reshape(2, nodes, -1) for part in np.split(flat[: ends[-1]], ends[:-1])]
    return [parts[k * len(widths) : (k + 1) * len(widths)] for k in range(classes)]


def _no_sums(codes: Codes, classes: int, nodes: int) -> np.ndarray:
    """Room for :func:`_sums`, and for (loss, rows) of both sides behind them."""
    return np.zeros(2 * classes * nodes * sum(codes.width(group) for group in codes.groups) + 4, dtype=np.int64)


def _add_up(sums: list[np.ndarray], turn: Turn, k: int, coded: np.ndarray, node: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> None:
    """Add the derivatives of class ``k`` to its sums, for the groups its tree may use."""
    for i, group in enumerate(turn.codes.groups):
        if set(group) & set(turn.columns[k]):
            _, nodes, width = sums[i].shape
            slot = coded[i] if node is None else coded[i] + node * width
            for d, value in enumerate((g, h)):
                found = np.bincount(slot, weights=value, minlength=nodes * width)
                sums[i][d] += found.reshape(nodes, width).astype(np.int64)


def _moved(rows: RDD, codes: Codes, classes: int, trees: list[list[Tree]]) -> RDD:
    """The rows with the margins after some more rounds."""

    def run(chunks: Iterator[_Chunk]) -> Iterator[_Chunk]:
        ways = with_ways(trees, codes)
        for chunk in chunks:
            yield chunk._replace(margins=raised(chunk.margins, ways, chunk.codes, codes))

    return rows.mapPartitions(run)


def _drawn(rows: RDD, turn: Turn) -> RDD:
    """What the levels of a round read."""
    settings = turn.settings

    def draw(chunk: _Chunk) -> _Drawn:
        key, test, label, coded, margins = chunk
        g, h, truth = gradients(margins, label)
        loss = np.rint(-np.log(np.maximum(truth, LEAST_SHARE)) * UNIT)
        losses = np.array([(int(loss[own].sum()), int(own.sum())) for own in (~test, test)], dtype=np.int64)
        use = np.flatnonzero(~test & (hashed(key, settings.seed + 104_729 * (turn.number + 1)) < settings.row_share))
        return _Drawn(coded.take(use, axis=1), np.stack([g, h]).take(use, axis=2).astype(np.float32), losses)

    return rows.map(draw)


def level_sums(rows: RDD, turn: Turn, open_trees: list[Tree], level: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of both derivatives by class, node of the level, feature and bin, and (loss, rows) of the training and the test side."""
    codes, columns = turn.codes, turn.columns
    classes, bins, nodes, features = len(open_trees), turn.settings.bins, 1 << level, len(codes.sizes)
    first = nodes - 1
    # The node of the level by place; rows that ended above it are counted as one more node.
    node_at = np.full(len(open_trees[0].feature), nodes, dtype=np.int64)
    node_at[first : first + nodes] = np.arange(nodes)
    counted = nodes + bool(level)

    def run(chunks: Iterator[_Drawn]) -> Iterator[np.ndarray]:
        flat, ways = _no_sums(codes, classes, counted), [Ways.of(tree, codes) for tree in open_trees]
        sums, losses = _sums(flat, codes, classes, counted), flat[-4:].reshape(2, 2)
        for chunk in chunks:
            losses += chunk.losses
            x, (g, h) = chunk.codes.astype(np.int64), chunk.derivatives.astype(np.float64)
            for k, tree in enumerate(open_trees):
                node = by_leaf(tree, ways[k], node_at, x, codes) if level else None
                _add_up(sums[k], turn, k, x, node, g[k], h[k])
        yield flat

    parts = rows.coalesce(tasks).mapPartitions(run)
    flat = parts.treeReduce(np.add) if tasks > AT_ONCE else sum(parts.collect(), _no_sums(codes, classes, counted))
    out = np.zeros((classes, nodes, features, bins, 2))
    for k, sums in enumerate(_sums(flat, codes, classes, counted)):
        for group, found in zip(codes.groups, sums, strict=True):
            whole = found[:, :nodes].reshape(2, nodes, *codes.shape(group))
            for place, f in enumerate(group):
                if f in columns[k]:
                    others = tuple(a + 2 for a in range(len(group)) if a != place)
                    out[k, :, f, : codes.sizes[f]] = np.moveaxis(whole.sum(axis=others), 0, -1)
    losses = flat[-4:].reshape(2, 2).astype(np.float64)
    losses[:, 0] /= UNIT
    return out / UNIT, losses


def cut_gains(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    """The gain of every cut of bins (last axis) into those below and the others; minus infinity where a side is too light."""
    left_g, left_h = np.cumsum(g, axis=-1)[..., :-1], np.cumsum(h, axis=-1)[..., :-1]
    all_g, all_h = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda a, b: a * a / (b + settings.penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    return np.where((left_h >= settings.least_weight) & (right_h >= settings.least_weight), gain, -np.inf)


def grown(tree: Tree, sums: np.ndarray, columns: list[int], level: int, settings: Settings) -> int:
    """Split the nodes of a level of one tree, in place, where that gains; how many were split.

    Among equal gains the first feature, then the lowest cut is taken.
    """
    def value(g: float, h: float) -> float:
        return -settings.rate * g / (h + settings.penalty)

    done, first = 0, (1 << level) - 1
    for i in range(1 << level):
        at = first + i
        if level and tree.feature[(at - 1) // 2] < 0:
            continue
        g, h = sums[i, columns, :, 0], sums[i, columns, :, 1]
        if level == 0:
            tree.value[0] = value(g[0].sum(), h[0].sum())
        gains = cut_gains(g, h, settings)
        best = np.unravel_index(np.argmax(gains), gains.shape)
        if gains.size and gains[best] > LEAST_GAIN:
            f, c = int(best[0]), int(best[1]) + 1
            tree.feature[at], tree.cut[at], tree.gain[at] = columns[f], c, gains[best]
            tree.value[2 * at + 1] = value(g[f, :c].sum(), h[f, :c].sum())
            tree.value[2 * at + 2] = value(g[f, c:].sum(), h[f, c:].sum())
            done += 1
    return done


def fitted(rows: DataFrame, key: str, label: str, test: Column, features: Sequence[str], classes: int, settings: Settings = Settings()) -> Boosted:
    """Trees grown over the rows that are not ``test``."""
    edges = bin_edges(rows.filter(~test), features, settings.bins)
    codes, n, spark = Codes.of(edges), len(features), rows.sparkSession
    shared_dir(spark)
    state = _held(_chunks(training_rows(rows, key, label, test, features, edges, classes), len(codes.groups), classes), stored=True)
    tasks = _level_tasks(state)
    stored, held = state, []
    trees: list[list[Tree]] = []
    history: list[tuple[int, float | None, float | None]] = []
    best = 0
    try:
        for turn in (Turn(i, [columns_of(settings, i, k, n) for k in range(classes)], codes, settings) for i in range(settings.rounds + 1)):
            growing = [Tree.bare(settings.depth) for _ in range(classes)]
            held.append(_held(_drawn(state, turn)))
            for level in range(settings.depth):
                sums, losses = level_sums(held[-1], turn, growing, level, tasks)
                if level == 0:
                    # What this round reads is there now; that of the round before is not read again.
                    _let_go(held[:-1])
                    held = held[-1:]
                    if state is not stored and state.isCheckpointed():
                        _let_go([stored])
                        let_go(spark, stored.getCheckpointFile())
                        stored = state
                if level == 0 and turn.number:
                    train, tested = (float(s / n) if n else None for s, n in losses)
                    history.append((turn.number, train, tested))
                    if tested is None or best == 0 or tested < history[best - 1][2]:
                        best = turn.number
                    if turn.number - best >= settings.patience or turn.number == settings.rounds:
                        return Boosted(tuple(features), edges, classes, trees[:best], history)
                if not sum(grown(tree, sums[k], turn.columns[k], level, settings) for k, tree in enumerate(growing)):
                    break
            trees.append(growing)
            state = _moved(state, codes, classes, [growing])
            if len(trees) % settings.stored_every == 0:
                state = _held(state, stored=True)
        return Boosted(tuple(features), edges, classes, trees, history)
    finally:
        _let_go([*held, state, stored])
        let_go(spark, stored.getCheckpointFile())


def _held(rows: RDD, stored: bool = False) -> RDD:
    """``rows``, there now: what reads them later would else run beside what makes them, with a Python process more for every core."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    if stored:
        rows.checkpoint()
    # Counted in the JVM, as a count in Python would be such a reader.
    rows._jrdd.rdd().count()
    return rows


def _level_tasks(state: RDD) -> int:
    """A task for every core, or more of ``LEVEL_ROWS`` rows: what a level gives back grows with its tasks."""
    rows = state.map(lambda chunk: len(chunk.key)).sum()
    return max(1, min(state.getNumPartitions(), max(state.ctx.defaultParallelism, -(-rows // LEVEL_ROWS))))


def _let_go(held: Sequence[RDD]) -> None:
    for rows in held:
        if rows.is_cached:
            rows.unpersist()


def root_gains(rows: DataFrame, key: str, label: str, features: Sequence[str], classes: int, settings: Settings = Settings()) -> list[tuple]:
    """(class, feature, threshold, gain) of the best first cut of every feature over all rows; features without one are left out."""
    settings = settings._replace(row_share=1.0, column_share=1.0)
    edges = bin_edges(rows, features, settings.bins)
    turn = Turn(0, [list(range(len(features)))] * classes, Codes.of(edges), settings)
    state = _chunks(training_rows(rows, key, label, F.lit(False), features, edges, classes), len(turn.codes.groups), classes)
    tasks = min(state.getNumPartitions(), max(AT_ONCE, state.ctx.defaultParallelism))
    sums, _ = level_sums(_drawn(state, turn), turn, [Tree.bare(1) for _ in range(classes)], 0, tasks)
    found = []
    for k in range(classes):
        gains = cut_gains(sums[k, 0, :, :, 0], sums[k, 0, :, :, 1], settings)
        for f, name in enumerate(features):
            c = int(np.argmax(gains[f]))
            if gains[f, c] > LEAST_GAIN:
                found.append((k, name, int(edges[f][c + 1]), float(gains[f, c])))
    return found


def with_shares(model: Boosted, rows: DataFrame, name: str = "shares") -> DataFrame:
    """``rows`` with the probability of every class as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes.of(model.edges)
        trees = with_ways(model.trees, codes)
        for batch in batches:
            coded = codes.coded(binned(_numbers(batch, model.features), model.edges))
            share = softmax(raised(np.zeros((model.classes, batch.num_rows)), trees, coded, codes))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * model.classes
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(share.T).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return rows.mapInArrow(run, f"{_fields(rows)}, `{name}` array<double>")


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def gains_of(model: Boosted) -> dict[str, float]:
    """The mean gain of the splits of every feature that has any."""
    gains: dict[str, list[float]] = {}
    for tree in (tree for turn in model.trees for tree in turn):
        for at in np.flatnonzero(tree.feature >= 0):
            gains.setdefault(model.features[tree.feature[at]], []).append(float(tree.gain[at]))
    return {f: sum(g) / len(g) for f, g in gains.items()}


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    """Three tables: nodes, edges of the bins, and the course of the losses."""
    nodes = [
        (r, k, at, int(tree.feature[at]), int(tree.cut[at]), float(tree.value[at]), float(tree.gain[at]))
        for r, turn in enumerate(model.trees)
        for k, tree in enumerate(turn)
        for at in range(len(tree.feature))
        if at == 0 or tree.feature[(at - 1) // 2] >= 0
    ]
    schema = "turn int, class int, place int, feature int, cut int, value double, gain double"
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    edges = [(i, f, model.classes, [int(e) for e in model.edges[i]]) for i, f in enumerate(model.features)]
    spark.createDataFrame(edges, "number int, feature string, classes int, edges array<long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    spark.createDataFrame(model.history, "turn int, train_loss double, test_loss double").coalesce(1).write.mode("overwrite").parquet(f"{path}/losses")


def load(spark: SparkSession, path: str) -> Boosted:
    """A stored model; its size depends on the settings it was grown with alone."""
    features = sorted(spark.read.parquet(f"{path}/features").collect())
    nodes = spark.read.parquet(f"{path}/nodes").collect()
    classes = features[0]["classes"] if features else 0
    size = max((n["place"] for n in nodes), default=0).bit_length()
    trees = [[Tree.bare(size) for _ in range(classes)] for _ in range(max((n["turn"] for n in nodes), default=-1) + 1)]
    for n in nodes:
        tree = trees[n["turn"]][n["class"]]
        tree.feature[n["place"]], tree.cut[n["place"]], tree.value[n["place"]], tree.gain[n["place"]] = n["feature"], n["cut"], n["value"], n["gain"]
    history = sorted(tuple(r) for r in spark.read.parquet(f"{path}/losses").collect())
    return Boosted(tuple(f["feature"] for f in features), [np.array(f["edges"], dtype=np.int64) for f in features], classes, trees, history)
