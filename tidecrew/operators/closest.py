"""The most similar buyers of every buyer: exact, and without a row per pair of buyers.

Every block of asking users meets every shard of all users in a task, which reads both from the shared folder; a task returns a few
users per asking one, and a window picks the best.  Within a task the products of the shard are of two kinds.  The list of a product with few buyers is gone through whole.
Users that have only much bought products in common with an asking user compare by those counts alone: users with the same counts
of such products make a pattern, its members are sorted by their norm, and only the first few of them can be among the nearest.
Patterns of the asking users meet patterns of the shard, so a product that everybody buys costs one comparison of two patterns,
however many buyers it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.plans.blockwise import blocks_for, met, packed
from tidecrew.plans.durable import kept
from tidecrew.sources.catalog import Tables

# Fixed value: neighbours looked at, the user included.
NEIGHBOURS = 5
# Buyers of a product in a shard up to which its list is gone through whole.
LIGHT = 256
# Purchase counts in a shard, and in a block of asking users; pairs held at a time.
ENTRIES = 1 << 22
LEAST_ENTRIES = 1 << 13
PAIRS = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def _runs(costs: np.ndarray) -> Iterator[slice]:
    """Cut into runs of ``PAIRS`` in all; a larger one is a run of its own."""
    at, total = 0, np.concatenate([[0], np.cumsum(costs)])
    while at < len(costs):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        yield slice(at, end)
        at = end


class Lists(NamedTuple):
    """Entries (owner, n) sorted by key; those of key k are ``start[k] .. start[k + 1] - 1``."""

    start: np.ndarray
    owner: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(key: np.ndarray, owner: np.ndarray, n: np.ndarray, keys: int) -> Lists:
        order = np.lexsort((owner, key))
        return Lists(np.concatenate([[0], np.cumsum(np.bincount(key, minlength=keys))]), owner[order], n[order])

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        return self.start[keys + 1] - self.start[keys]


class Patterns(NamedTuple):
    """Users by their counts of much bought products: the pattern of every user (-1: none), and entries by pattern."""

    of: np.ndarray
    entries: Lists


def patterns_of(user: np.ndarray, product: np.ndarray, n: np.ndarray, users: int) -> Patterns:
    """Users with equal entries share a pattern; told apart by two 64-bit sums over the entries."""
    with np.errstate(over="ignore"):
        one = _mixed(product.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
        other = _mixed(one + np.uint64(0x632BE59BD9B4E019))
        sums = np.zeros((users, 2), dtype=np.uint64)
        np.add.at(sums, user, np.stack([one, other], axis=1))
    count = np.bincount(user, minlength=users)
    having = np.flatnonzero(count)
    order = having[np.lexsort((sums[having, 0], sums[having, 1], count[having]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sums[order[1:]] != sums[order[:-1]]).any(axis=1) | (count[order[1:]] != count[order[:-1]])
    of = np.full(users, -1, dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    first = np.full(users, False)
    first[order[new]] = True
    own = first[user]
    return Patterns(of, Lists.of(of[user[own]], product[own], n[own], int(new.sum())))


class Shard(NamedTuple):
    """Users in order of their ids with norms; products with few buyers as lists of users, the others as lists of patterns."""

    ids: np.ndarray
    norm: np.ndarray
    products: np.ndarray
    hot: np.ndarray
    light: Lists
    patterns: Patterns
    by_product: Lists
    members: Lists
    pattern_keys: np.ndarray


def shard_of(user: np.ndarray, product: np.ndarray, n: np.ndarray, k: int) -> Shard:
    ids, user = np.unique(user, return_inverse=True)
    products, product = np.unique(product, return_inverse=True)
    norm = np.zeros(len(ids), dtype=np.int64)
    np.add.at(norm, user, n * n)
    hot = np.bincount(product, minlength=len(products)) > LIGHT
    much = hot[product]
    light = Lists.of(product[~much], user[~much], n[~much], len(products))
    patterns = patterns_of(user[much], product[much], n[much], len(ids))
    count = len(patterns.entries.start) - 1
    pattern = np.repeat(np.arange(count), np.diff(patterns.entries.start))
    by_product = Lists.of(patterns.entries.owner, pattern, patterns.entries.n, len(products))
    # Only the k members of the smallest norms, then ids, of a pattern can be among the nearest by the pattern alone.
    having = np.flatnonzero(patterns.of >= 0)
    order = having[np.lexsort((having, norm[having], patterns.of[having]))]
    begin = np.concatenate([[0], np.cumsum(np.bincount(patterns.of[having], minlength=count))])
    chosen = order[np.arange(len(order)) - begin[patterns.of[order]] < k]
    members = Lists(np.concatenate([[0], np.cumsum(np.bincount(patterns.of[chosen], minlength=count))]), chosen, norm[chosen])
    return Shard(ids, norm, products, hot, light, patterns, by_product, members, pattern * len(products) + patterns.entries.owner)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, none of them negative, added up by key, in order of the key."""
    if not len(key):
        return key, value
    least, bits = int(key.min()), int(value.max()).bit_length()
    if (int(key.max()) - least).bit_length() + bits < 64:
        # Both as one number: sorting numbers takes a fraction of the time that sorting their places does.
        one = np.sort(((key - least) << bits) | value)
        key, value = (one >> bits) + least, one & ((1 << bits) - 1)
    else:
        order = np.argsort(key)
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(value, first)


def _products(lists: Lists, keys: np.ndarray, n: np.ndarray, owner: np.ndarray, others: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner * others + other, sum of n times the other's n) over the lists of ``keys``.

    One owner with more pairs than ``PAIRS`` is added up in an array of all others, list by list.
    """
    sizes = lists.sizes(keys)
    if len(keys) and int(sizes.sum()) > PAIRS and (owner == owner[0]).all():
        total = np.zeros(others, dtype=np.int64)
        for key, count in zip(keys.tolist(), n.tolist(), strict=True):
            own = slice(lists.start[key], lists.start[key + 1])
            total[lists.owner[own]] += count * lists.n[own]
        some = np.flatnonzero(total)
        return owner[0] * others + some, total[some]
    at = _spans(lists.start[keys], sizes)
    return _summed(np.repeat(owner, sizes) * others + lists.owner[at], np.repeat(n, sizes) * lists.n[at])


def _best(group: np.ndarray, user: np.ndarray, dot: np.ndarray, shard: Shard, k: int) -> np.ndarray:
    """Places of the k nearest of every group: by closeness, then by id, which is the order of the users."""
    norm = shard.norm[user]
    closeness = dot.astype(np.float64) * dot / norm
    order = np.lexsort((user, -closeness, group))
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[rank < k]


def _best_in_order(group: np.ndarray, user: np.ndarray, dot: np.ndarray, shard: Shard, k: int) -> np.ndarray:
    """:func:`_best` of rows that are sorted by group and user: the largest of every group is taken out, k times over."""
    if not len(group):
        return np.zeros(0, dtype=np.int64)
    closeness = dot.astype(np.float64) * dot / shard.norm[user]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    out = []
    for _ in range(k):
        hit = np.flatnonzero((closeness == np.maximum.reduceat(closeness, first)[number]) & (closeness >= 0))
        new = np.ones(len(hit), dtype=bool)
        new[1:] = number[hit[1:]] != number[hit[:-1]]
        out.append(hit[new])
        closeness[hit[new]] = -1
    best = np.concatenate(out)
    # Those of a group one after the other, as they were taken out.
    return best[np.argsort(group[best], kind="stable")]


def by_patterns(shard: Shard, asking: Patterns, k: int) -> Lists:
    """The k users nearest to every pattern of the asking users, by much bought products alone, as (user, dot)."""
    count, others = len(asking.entries.start) - 1, len(shard.members.start) - 1
    costs = np.add.reduceat(np.append(shard.by_product.sizes(asking.entries.owner), 0), asking.entries.start[:-1]) if count else np.zeros(0)
    groups, users, dots = [], [], []
    for run in _runs(costs):
        own = slice(asking.entries.start[run.start], asking.entries.start[run.stop])
        pattern = np.repeat(np.arange(run.start, run.stop), np.diff(asking.entries.start[run.start : run.stop + 1]))
        key, dot = _products(shard.by_product, asking.entries.owner[own], asking.entries.n[own], pattern, others)
        group, other = np.divmod(key, max(others, 1))
        sizes = shard.members.sizes(other)
        at = _spans(shard.members.start[other], sizes)
        group, user, dot = np.repeat(group, sizes), shard.members.owner[at], np.repeat(dot, sizes)
        best = _best(group, user, dot, shard, k)
        groups.append(group[best])
        users.append(user[best])
        dots.append(dot[best])
    if not groups:
        return Lists(np.zeros(count + 1, dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * 2)
    group = np.concatenate(groups)
    return Lists(np.concatenate([[0], np.cumsum(np.bincount(group, minlength=count))]), np.concatenate(users), np.concatenate(dots))


def _pattern_dots(shard: Shard, asking: Patterns, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sum over much bought products for pairs of patterns; zero where one has none."""
    out = np.zeros(len(one), dtype=np.int64)
    both = np.flatnonzero((one >= 0) & (other >= 0))
    count = max(1, len(shard.members.start) - 1)
    pairs, back = np.unique(one[both] * count + other[both], return_inverse=True)
    a, b = np.divmod(pairs, count)
    found = np.zeros(len(pairs), dtype=np.int64)
    for run in _runs(asking.entries.sizes(a)):
        sizes = asking.entries.sizes(a[run])
        at = _spans(asking.entries.start[a[run]], sizes)
        keys = np.repeat(b[run], sizes) * len(shard.products) + asking.entries.owner[at]
        place = np.minimum(np.searchsorted(shard.pattern_keys, keys), len(shard.pattern_keys) - 1)
        hit = shard.pattern_keys[place] == keys
        pair = np.repeat(np.arange(len(sizes)), sizes)
        value = np.where(hit, asking.entries.n[at] * shard.patterns.entries.n[place], 0)
        np.add.at(found[run], pair, value)
    out[both] = found[back]
    return out


class Asking(NamedTuple):
    """Entries (user, product, n) of a block of asking users, sorted by user; both are places in sorted lists of ids."""

    names: np.ndarray
    products: np.ndarray
    user: np.ndarray
    product: np.ndarray
    n: np.ndarray


def asking_of(user: np.ndarray, product: np.ndarray, n: np.ndarray) -> Asking:
    names, user = np.unique(user, return_inverse=True)
    products, product = np.unique(product, return_inverse=True)
    order = np.argsort(user, kind="stable")
    return Asking(names, products, user[order].astype(np.int32), product[order].astype(np.int32), n[order])


def nearest_in(shard: Shard, user: np.ndarray, product: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(target, user, dot) of the k nearest other users in the shard that share a product with each asking user."""
    return nearest_to(shard, asking_of(user, product, n), k)


def nearest_to(shard: Shard, block: Asking, k: int) -> tuple[np.ndarray, ...]:
    """:func:`nearest_in` for a block of users that was sorted once, however many shards it meets."""
    if not len(shard.ids):
        return (np.zeros(0, dtype=np.int64),) * 3
    names = block.names
    at = np.minimum(np.searchsorted(shard.products, block.products), len(shard.products) - 1)
    at = np.where(shard.products[at] == block.products, at, -1)[block.product]
    known = np.flatnonzero(at >= 0)
    user, product, n = block.user[known].astype(np.int64), at[known], block.n[known]
    own = np.minimum(np.searchsorted(shard.ids, names), len(shard.ids) - 1)
    own = np.where(shard.ids[own] == names, own, -1)
    much = shard.hot[product]
    asking = patterns_of(user[much], product[much], n[much], len(names))
    # One more than asked for, since the user may be among them.
    hot_lists = by_patterns(shard, asking, k + 1)
    light_user, light_product, light_n = user[~much], product[~much], n[~much]
    bounds = np.searchsorted(light_user, np.arange(len(names) + 1))
    sizes = np.concatenate([[0], np.cumsum(shard.light.sizes(light_product))])
    out = []
    for run in _runs(sizes[bounds[1:]] - sizes[bounds[:-1]] + k + 1):
        part = slice(bounds[run.start], bounds[run.stop])
        key, dot = _products(shard.light, light_product[part], light_n[part], light_user[part], len(shard.ids))
        group, other = np.divmod(key, len(shard.ids))
        asked = np.arange(run.start, run.stop)
        asked = asked[asking.of[asked] >= 0]
        new = np.ones(len(group), dtype=bool)
        if len(asked):
            dot = dot + _pattern_dots(shard, asking, asking.of[group], shard.patterns.of[other])
            many = hot_lists.sizes(asking.of[asked])
            spot = _spans(hot_lists.start[asking.of[asked]], many)
            group, other, dot = (
                np.concatenate(x) for x in ((group, np.repeat(asked, many)), (other, hot_lists.owner[spot]), (dot, hot_lists.n[spot]))
            )
            # A user that also shares a product of few buyers is there twice; the larger sum is the whole one.
            order = np.lexsort((-dot, other, group))
            group, other, dot = group[order], other[order], dot[order]
            new = np.ones(len(group), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
        some = np.flatnonzero(new & (other != own[group]))
        best = some[_best_in_order(group[some], other[some], dot[some], shard, k)]
        out.append((names[group[best]], other[best], dot[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


def similar_users_of_all(t: Tables, k: int = NEIGHBOURS) -> DataFrame:
    """For every buyer the ``k`` users whose purchase counts have the largest cosine with theirs, the user first.

    (target, position, user_id, dot, norm, closeness), as for a cohort; buyers without a common product fill a list up in order of
    their ids.
    """
    bought = t.purchases.filter("user_id is not null and product_id is not null")
    counts = kept(bought.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    rows, cores = counts.count(), counts.sparkSession.sparkContext.defaultParallelism
    shards = blocks_for(rows, ENTRIES, ENTRIES, cores)
    blocks = blocks_for(rows, ENTRIES, LEAST_ENTRIES, -(-cores // shards))
    norms = counts.groupBy("user_id").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))

    def arrays(rows: pa.Table) -> list[np.ndarray]:
        return [rows.column(c).to_numpy() for c in ("user_id", "product_id", "n")]

    def run(shard: Shard, asking: Asking) -> pa.Table:
        target, other, dot = nearest_to(shard, asking, k - 1)
        return pa.table({"target": target, "user_id": shard.ids[other], "dot": dot, "norm": shard.norm[other]})

    found = met(
        packed(counts, "user_id", shards, lambda rows: shard_of(*arrays(rows), k + 1)),
        packed(counts, "user_id", blocks, lambda rows: asking_of(*arrays(rows))),
        run,
        "target long, user_id long, dot long, norm long",
    )
    selves = norms.select(F.col("user_id").alias("target"), "user_id", F.col("norm").alias("dot"), "norm")
    columns = ["target", "user_id", "dot", "norm", "closeness"]

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("closeness", F.col("dot").cast("double") * F.col("dot") / F.col("norm"))
        nearest = Window.partitionBy("target").orderBy(F.col("user_id") != F.col("target"), F.desc("closeness"), "user_id")
        return rows.withColumn("position", F.row_number().over(nearest)).filter(F.col("position") <= k)

    top = kept(ranked(found.unionByName(selves)), "nearest")
    short = top.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k).select("target")
    # The k lowest ids are enough to fill any list up: no more than k - 1 of them are in it.
    lowest = norms.orderBy("user_id").limit(k).agg(F.collect_list(F.struct("user_id", "norm"))).scalar()
    filled = (
        short.withColumn("one", F.explode(lowest))
        .select("target", "one.user_id", F.lit(0).cast("bigint").alias("dot"), "one.norm")
        .join(top.select("target", "user_id"), ["target", "user_id"], "left_anti")
    )
    again = top.join(short, "target", "left_semi").select("target", "user_id", "dot", "norm")
    whole = top.join(short, "target", "left_anti").unionByName(ranked(again.unionByName(filled)))
    return whole.select("target", "position", *columns[1:])
