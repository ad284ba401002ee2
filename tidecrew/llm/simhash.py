"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A fingerprint has one bit for each of 64 positions: set if the bit is set in more than half of the hashes of the text's
word shingles.  Equal fingerprints are one class, so copies cost one row however many there are.  Classes
are dealt to shards by a vantage-point tree fitted on a bounded sample: at each node a fingerprint goes in or out by its Hamming
distance to the vantage point.  Every class lives in one shard and visits the others whose region a ball of the
linking distance around it may touch (from the outside of a node in; the other way round is the same pair).  By the
triangle inequality no other shard can hold a partner, so the pairs found are exact, whatever the sample.  Within a shard the search splits on by vantage points of its own.  A shard returns a
spanning set of its links, no more rows than it was given, and groups across shards are joined by alternating
large-star and small-star steps.  A shard of more than ``ROWS`` fingerprints is cut into blocks by hash, and every pair of
its blocks is a task of its own, so that no task grows with the corpus.

Defined cases: a NULL or empty text has no shingles and fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; rows may repeat; a NULL id counts as larger than all others in a group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import texts_of
from tidecrew.llm.tables import packed, row_key, stored, unpacked, without
from tidecrew.plans.combine import spread_out

SHINGLE = 3
DISTANCE = 2
SEED = 42
# Fingerprints the tree of shards is fitted on, classes a shard is meant for, and shards, at most.
SAMPLE = 1 << 16
SHARD = 4_096
SHARDS = 1 << 12
# Fingerprints in a block of a shard, about; a task searches two blocks at most.
ROWS = 1 << 19
LEAF = 1_024


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    whole = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = ends - [len(word) + 1 for word in words]
    size = min(shingle, len(words))
    pairs = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in pairs], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in more than half of the hashes; zero if there are none."""
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text over its word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, shingle) for text in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree(NamedTuple):
    """Nodes as arrays: a fingerprint within ``radius`` of the vantage point goes to ``inside``, else to ``outside``.
    A negative child is the shard with that number, counted from -1 down."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray


def split_of(homes: np.ndarray, visitors: np.ndarray, distance: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, among a few, that leave the fewest comparisons; None if none saves a tenth.

    Homes are compared with homes and visitors.  What is outside but near the border visits the inside; visitors go
    wherever they may find a partner.
    """
    now = len(homes) * (len(homes) + len(visitors))
    best = None
    for vantage in homes[np.linspace(0, len(homes) - 1, 8).astype(int)]:
        far = hamming(homes, vantage)
        own = np.cumsum(np.bincount(far, minlength=65))
        others = np.cumsum(np.bincount(hamming(visitors, vantage), minlength=65))
        for radius in np.unique(np.quantile(far, [0.35, 0.5, 0.65]).astype(int)).tolist():
            inside, border = int(own[radius]), int(own[min(64, radius + distance)])
            into = int(others[min(64, radius + distance)])
            out = len(visitors) - (int(others[radius - distance]) if radius >= distance else 0)
            rest = len(homes) - inside
            cost = inside * (border + into) + rest * (rest + out)
            if best is None or cost < best[0]:
                best = (cost, vantage, radius)
    return best[1:] if best is not None and best[0] < 0.9 * now else None


def _ways(far: np.ndarray, home: np.ndarray, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints go inside and outside: homes to their side, and inside as visitors if near the border."""
    return far <= radius + distance, far > np.where(home, radius, radius - distance)


def fit_tree(sample: np.ndarray, distance: int, leaf: int) -> Tree:
    nodes: list[list[int]] = []
    shards = 0

    def grow(values: np.ndarray) -> int:
        nonlocal shards
        found = split_of(values, values[:0], distance) if len(values) > leaf else None
        if found is None:
            shards += 1
            return -shards
        vantage, radius = found
        at = len(nodes)
        nodes.append([int(vantage), radius, 0, 0])
        near = hamming(values, vantage) <= radius
        nodes[at][2] = grow(values[near])
        nodes[at][3] = grow(values[~near])
        return at

    grow(np.unique(sample))
    columns = list(zip(*nodes, strict=True)) or [()] * 4
    return Tree(*[np.array(c, dtype=t) for c, t in zip(columns, (np.uint64, np.int16, np.int64, np.int64), strict=True)])


def shards_of(tree: Tree, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for every shard that a fingerprint lives in or has to visit."""
    rows, shards, homes = [], [], []
    todo = [(0 if len(tree.vantage) else -1, np.arange(len(values)), np.ones(len(values), dtype=bool))]
    while todo:
        node, at, home = todo.pop()
        if node < 0:
            rows.append(at)
            shards.append(np.full(len(at), -node - 1))
            homes.append(home)
        elif len(at):
            far, radius = hamming(values[at], tree.vantage[node]), tree.radius[node]
            into, out = _ways(far, home, radius, distance)
            todo.append((tree.inside[node], at[into], home[into] & (far[into] <= radius)))
            todo.append((tree.outside[node], at[out], home[out]))
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class _Sets:
    """Disjoint sets over positions; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return int(k)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def linked(values: np.ndarray, home: np.ndarray, distance: int, leaf: int = LEAF) -> np.ndarray:
    """For different fingerprints, the position of the first one reachable over links that have a home at one end."""
    sets = _Sets(len(values))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        homes, visitors = todo.pop()
        big = len(homes) * (len(homes) + len(visitors)) > leaf * leaf * 8
        found = split_of(values[homes], values[visitors], distance) if big else None
        if found is not None:
            vantage, radius = found
            own, other = hamming(values[homes], vantage), hamming(values[visitors], vantage)
            border = homes[(own > radius) & (own <= radius + distance)]
            todo.append((homes[own <= radius], np.concatenate([border, visitors[other <= radius + distance]])))
            todo.append((homes[own > radius], visitors[other > radius - distance]))
            continue
        partners = np.concatenate([homes, visitors])
        for begin in range(0, len(homes), 256):
            block = homes[begin : begin + 256]
            a, b = np.nonzero(hamming(values[block, None], values[None, partners[begin:]]) <= distance)
            for i, j in zip(block[a].tolist(), partners[begin:][b].tolist(), strict=True):
                if sets.up[i] != sets.up[j]:
                    sets.join(i, j)
    return np.array([sets.root(k) for k in range(len(values))], dtype=np.int64)


def block_counts(dealt: DataFrame, rows: int | None = None) -> DataFrame:
    """(shard, blocks) of the shards that hold more than ``rows`` fingerprints: ``SHARDS`` rows at most."""
    rows = ROWS if rows is None else rows
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    return sizes.select("shard", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))


def _tasks() -> Column:
    """The tasks of a row: its shard, or every pair of blocks of its shard that its own block is in.

    Links within a block are found in any pair the block is in.  A task is a number of shard and blocks, below 2 ** 52.
    """
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: (k != own) | (blocks == 1))
    first = F.col("shard") * (1 << 20)
    return F.explode(F.transform(others, lambda k: (first + F.least(own, k)) * (1 << 20) + F.greatest(own, k)))


def links(classes: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b) with a > b: spanning links between the fingerprints ``fp`` of ``classes``, which are different."""
    n = classes.count()
    chosen = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow().column("fp").to_numpy()
    shards = min(SHARDS, max(1, -(-n // shard)))
    tree = classes.sparkSession.sparkContext.broadcast(
        fit_tree(chosen.astype(np.int64).view(np.uint64), distance, -(-len(chosen) // shards))
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            rows, shard, home = shards_of(tree.value, values, distance)
            columns = [pa.array(shard), pa.array(values[rows].view(np.int64)), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "fp", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(group["fp"].to_numpy().view(np.uint64), return_index=True)
        roots = linked(values, group["home"].to_numpy(dtype=bool)[at], distance)
        own = np.flatnonzero(roots != np.arange(len(values)))
        return pd.DataFrame({"a": values[own].view(np.int64), "b": values[roots[own]].view(np.int64)})

    dealt = stored(classes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean"), "shards")
    tasks = dealt.join(F.broadcast(block_counts(dealt)), "shard", "left").select("fp", "home", _tasks().alias("task"))
    # Shards are few bytes but much work each, so their number of tasks is given outright.
    found = spread_out(tasks, "task").groupBy("task").applyInPandas(search, "a long, b long").distinct()
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low")), "stars")
    return both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), "stars")
    joined = edges.join(least, F.col("a") == F.col("node"))
    moved = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a > b): the smallest node it is connected with; roots are left out.

    Alternating stars need a number of rounds that grows with the logarithm of the component size; each is stored.
    """
    state, before = stored(edges, "links"), None
    while True:
        summary = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summary == before or not summary[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = summary
        state = stored(_small_star(_large_star(state)), "links")


def _named(rows: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(id, fp, component): the smallest id reachable over the links between fingerprints, for every row."""
    roots = components(edges)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy(F.col("root").alias("top")).agg(F.min("low").alias("component"))
    # Stored, so that the join below sees two plain inputs and can split a fingerprint with very many rows.
    named = stored(
        rooted.join(lowest, F.col("root") == F.col("top")).select(F.col("fp").alias("_fp"), "component"), "components"
    )
    return rows.join(named, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component")


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(id, fp, component): the smallest id reachable over links, for every row."""
    rows = stored(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("low")), "classes")
    return _named(rows, classes, links(classes, distance), id_col)


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """The documents, all columns, but one of each group of :func:`grouped`: that with the smallest id, then hash of the text."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    groups = grouped(keyed, "key", "text", shingle, distance)
    found = stored(groups, "groups")
    left = without(docs, found.filter("key <> component").select("key").distinct(), id_col, text_col)
    # Of rows with the same id and text, all but one go, too; as a rule there are none.
    again = stored(found.filter("key = component").groupBy("key").count().filter("count > 1").select("key"), "repeated")
    if again.isEmpty():
        return left
    named = packed(left, own=row_key(id_col, text_col))
    once = named.join(again.select(F.col("key").alias("again")), F.col("own") == F.col("again"), "left_semi")
    return without(left, again, id_col, text_col).unionByName(unpacked(once.dropDuplicates(["own"]), docs.columns))
