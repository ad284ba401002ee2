"""Boosted trees against a plain version that goes through the rows one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecrew.operators import boosted, training
from tidecrew.operators.boosted import Settings
from tidecrew.plans.combine import parts_for

FEATURES = ("a", "b", "c")


def drawn(seed, n):
    """Rows whose label follows the features, some at random."""
    rnd = random.Random(seed)
    rows = []
    for key in range(n):
        a, b, c = rnd.randrange(40), rnd.choice([None, *range(6)]), rnd.randrange(-500, 500)
        label = 0 if a < 15 else 1 if (b or 0) > 2 else 2
        rows.append((key, rnd.randrange(3) if rnd.random() < 0.2 else label, key % 5 == 0, a, b, c))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, label int, held boolean, a int, b int, c int")


def plain_edges(rows, bins):
    out = []
    for i in range(3):
        values = sorted(r[3 + i] for r in rows if not r[2] and r[3 + i] is not None)
        if len(set(values)) <= bins:
            out.append(sorted(set(values)))
        else:
            first = {}
            for v in sorted(set(values)):
                first.setdefault(sum(x < v for x in values) * bins // len(values), v)
            out.append(sorted(first.values()))
    return out


def plain_fit(rows, edges, settings, rounds):
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, one list per round."""
    margins = {r[0]: [0.0] * 3 for r in rows}
    number = lambda v: -math.inf if v is None else v
    trees = []

    def shares(key):
        powers = [math.exp(m - max(margins[key])) for m in margins[key]]
        return [p / sum(powers) for p in powers]

    def grow(own, k, columns, depth):
        g, h = sum(x[1] for x in own), sum(x[2] for x in own)
        score = lambda a, b: a * a / (b + settings.penalty)
        best = (1e-6, None)
        for f in columns if depth < settings.depth else ():
            for threshold in edges[f][1:]:
                left = [x for x in own if number(x[0][3 + f]) < threshold]
                lg, lh = sum(x[1] for x in left), sum(x[2] for x in left)
                if lh >= settings.least_weight and h - lh >= settings.least_weight:
                    gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, threshold)
        if best[1] is None:
            return -settings.rate * g / (h + settings.penalty)
        _, f, threshold = best
        sides = [[x for x in own if (number(x[0][3 + f]) >= threshold) is right] for right in (False, True)]
        return (f, threshold, *[grow(side, k, columns, depth + 1) for side in sides])

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if number(row[3 + tree[0]]) >= tree[1] else tree[2]
        return tree

    for turn in range(rounds):
        used = [r for r in rows if not r[2] and boosted.hashed(np.array([r[0]]), settings.seed + 104_729 * (turn + 1))[0] < settings.row_share]
        own_trees = []
        for k in range(3):
            own = []
            for r in used:
                p = shares(r[0])[k]
                first, second = round((p - (r[1] == k)) * 2**24) / 2**24, round(2 * p * (1 - p) * 2**24) / 2**24
                own.append((r, first, second))
            own_trees.append(grow(own, k, boosted.columns_of(settings, turn, k, 3), 0))
        for r in rows:
            for k in range(3):
                margins[r[0]][k] += value(own_trees[k], r)
        trees.append(own_trees)
    return trees, {key: shares(key) for key in margins}


def nested(model, tree, at=0):
    if tree.feature[at] < 0:
        return float(tree.value[at])
    f = int(tree.feature[at])
    return (f, int(model.edges[f][tree.cut[at]]), nested(model, tree, 2 * at + 1), nested(model, tree, 2 * at + 2))


def same(one, other):
    if isinstance(one, tuple) and isinstance(other, tuple):
        return one[:2] == other[:2] and same(one[2], other[2]) and same(one[3], other[3])
    return not isinstance(one, tuple) and not isinstance(other, tuple) and one == pytest.approx(other, abs=1e-6)


@pytest.mark.parametrize("bins,stored_every", [(256, 10), (16, 2)])
def test_trees_equal_plain_ones(spark, bins, stored_every):
    rows = drawn(bins, 400)
    settings = Settings(rounds=5, patience=5, depth=3, bins=bins, stored_every=stored_every)
    model = boosted.fitted(frame(spark, rows).repartition(5), "key", "label", F.col("held"), FEATURES, 3, settings)
    edges = plain_edges(rows, bins)
    assert [e.tolist() for e in model.edges] == edges
    rounds = len(model.trees)
    trees, shares = plain_fit(rows, edges, settings, rounds)
    assert all(same(nested(model, t), p) for turn, plain in zip(model.trees, trees, strict=True) for t, p in zip(turn, plain, strict=True))
    got = {r.key: r.shares for r in boosted.with_shares(model, frame(spark, rows)).collect()}
    assert all(got[key] == pytest.approx(shares[key], abs=1e-6) for key in shares)
    assert len(model.history) == 5 and min(model.history, key=lambda h: h[2])[0] == rounds
    test = [-math.log(shares[r[0]][r[1]]) for r in rows if r[2]]
    assert model.history[rounds - 1][2] == pytest.approx(sum(test) / len(test), abs=1e-5)


def test_growing_stops_and_partitions_do_not_matter(spark):
    rnd = random.Random(1)
    noise = [(k, rnd.randrange(3), k % 5 == 0, rnd.randrange(40), rnd.randrange(6), rnd.randrange(500)) for k in range(500)]
    settings = Settings(rounds=30, patience=2, depth=4)
    models = [boosted.fitted(frame(spark, noise).repartition(n), "key", "label", F.col("held"), FEATURES, 3, settings) for n in (1, 6)]
    assert models[0].history == models[1].history and len(models[0].history) < 30
    assert len(models[0].history) == len(models[0].trees) + 2
    one, other = ([nested(m, t) for turn in m.trees for t in turn] for m in models)
    assert one == other


def test_a_learnt_table_beats_the_shares_of_its_classes(spark):
    rows = drawn(7, 1500)
    model = boosted.fitted(frame(spark, rows), "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=8, depth=4))
    assert model.history[len(model.trees) - 1][2] < 0.75 < math.log(3)
    gains = boosted.gains_of(model)
    assert gains["a"] > gains["c"] and gains["b"] > gains["c"]


def test_stored_models_are_the_same(spark, tmp_path):
    rows = drawn(3, 200)
    model = boosted.fitted(frame(spark, rows), "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=2, depth=3))
    boosted.save(model, spark, str(tmp_path))
    again = boosted.load(spark, str(tmp_path))
    assert again.history == model.history and again.features == model.features
    shares = [{r.key: r.shares for r in boosted.with_shares(m, frame(spark, rows)).collect()} for m in (model, again)]
    assert shares[0] == shares[1]


def test_odd_tables(spark):
    rows = frame(spark, [(None, 0, False, None, None, None), (1, 1, False, 1, 1, 1), (1, None, False, 1, 1, 1)])
    model = boosted.fitted(rows, "key", "label", F.col("held"), FEATURES, 2, Settings(rounds=2, depth=2))
    assert all(len(r.shares) == 2 for r in boosted.with_shares(model, rows).collect())
    empty = boosted.fitted(rows.limit(0), "key", "label", F.col("held"), FEATURES, 2, Settings(rounds=2, depth=2))
    assert [r.shares for r in boosted.with_shares(empty, rows.limit(1)).collect()] == [[0.5, 0.5]]


def test_a_level_reads_chunks_of_rows_with_their_margins(spark, monkeypatch):
    """A row of the table holds many rows, and no level goes through the trees of earlier rounds again."""
    rows = frame(spark, drawn(1, 3_000)).coalesce(1)
    stored = boosted.training_rows(rows, "key", "label", F.col("held"), FEATURES, boosted.bin_edges(rows, FEATURES, 16), 3)
    assert stored.count() <= 2 * max(spark.sparkContext.defaultParallelism, 8)
    steps, moved = [], boosted._moved
    monkeypatch.setattr(boosted, "_moved", lambda state, features, classes, trees: steps.append(len(trees)) or moved(state, features, classes, trees))
    model = boosted.fitted(rows, "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=3, depth=2))
    assert steps and set(steps) == {1} and len(model.history) <= 3


def random_tree(rnd, depth, sizes):
    tree = boosted.Tree.bare(depth)
    for at in range((1 << depth) - 1):
        if (at == 0 or tree.feature[(at - 1) // 2] >= 0) and rnd.random() < 0.9:
            f = rnd.randrange(len(sizes))
            tree.feature[at], tree.cut[at] = f, rnd.randrange(1, sizes[f])
    return tree


@pytest.mark.parametrize("depth", [1, 6, 8])
def test_leaves_by_bits_are_those_found_level_by_level(depth):
    """Features of few bins are looked up as one number, and the way down a tree is not gone node by node."""
    rnd, sizes = random.Random(depth), (4, 300, 2, 40)
    codes = boosted.Codes.of([np.arange(n) for n in sizes])
    assert sorted(map(sorted, codes.groups)) == [[0, 2, 3], [1]]
    bins = np.array([[rnd.randrange(n) for _ in range(500)] for n in sizes])
    coded = codes.coded(bins)
    for _ in range(20):
        tree = random_tree(rnd, depth, sizes)
        at = np.zeros(500, dtype=np.int64)
        for i in range(500):
            while tree.feature[at[i]] >= 0:
                at[i] = 2 * at[i] + 1 + (bins[tree.feature[at[i]], i] >= tree.cut[at[i]])
        ways = boosted.Ways.of(tree, codes)
        assert (ways is None) == (int((tree.feature >= 0).sum()) >= boosted.LEAVES)
        for form in (None, ways):
            assert boosted.by_leaf(tree, form, np.arange(len(tree.feature)), coded, codes).tolist() == at.tolist()


def test_nothing_is_held_after_growing(spark, tmp_path):
    """The rows were written out every few rounds, and all of these tables stayed."""
    rows = frame(spark, drawn(5, 300)).localCheckpoint()
    context = spark.sparkContext
    held, old = context._jsc.getPersistentRDDs().size(), context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        boosted.fitted(rows, "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=4, depth=2, stored_every=1))
    finally:
        if old:
            context.setCheckpointDir(old.removeprefix("file:"))
    # What is left is the histogram of the values, a checkpoint of its own.
    assert len([p for p in tmp_path.glob("*/rdd-*")]) == 1
    assert context._jsc.getPersistentRDDs().size() == held


def test_a_level_has_few_tasks_and_reads_drawn_rows_alone(spark, monkeypatch):
    """A task gives back sums of a whole level, so many small ones cost more than the rows; a level read all rows with margins."""
    rows = frame(spark, drawn(5, 2_000)).repartition(40)
    monkeypatch.setattr(boosted, "spread_out", lambda df, key: df.repartition(40, key))
    seen, sums = [], boosted.level_sums

    def level_sums(rows, turn, trees, level, tasks):
        seen.append((tasks, rows.map(len).distinct().collect(), rows.map(lambda d: d.codes.shape[1]).sum()))
        return sums(rows, turn, trees, level, tasks)

    monkeypatch.setattr(boosted, "level_sums", level_sums)
    boosted.fitted(rows, "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=1, depth=2))
    assert {tasks for tasks, _, _ in seen} == {spark.sparkContext.defaultParallelism}
    assert {tuple(fields) for _, fields, _ in seen} == {(3,)} and all(n < 0.7 * 2_000 for _, _, n in seen)


def test_products_are_scored_by_all_cores(spark, small):
    """The numbering's shuffle by product did for the spreading too, and its few small partitions were merged."""
    model = boosted.Boosted(training.FEATURES, [np.arange(2)] * len(training.FEATURES), 5, [], [])
    scores = training.model_scores(small, model, [1, 2, 3, 4, 5], 2)
    assert scores.rdd.getNumPartitions() == parts_for(spark)


def test_the_rows_of_a_round_are_there_before_a_level_reads_them(spark, monkeypatch):
    """Making and reading them in one task took two Python processes for every core, and a batch handed to one was a whole partition."""
    rows = frame(spark, drawn(5, 1_000))
    sums, seen = boosted.level_sums, []

    def level_sums(rows, *rest):
        infos = {info.id(): info.numCachedPartitions() for info in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
        seen.append(infos.get(rows.id()) == rows.getNumPartitions() > 0)
        return sums(rows, *rest)

    monkeypatch.setattr(boosted, "level_sums", level_sums)
    boosted.fitted(rows, "key", "label", F.col("held"), FEATURES, 3, Settings(rounds=2, depth=2, stored_every=1))
    assert seen and all(seen)
