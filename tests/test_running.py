"""Distributed numbering and lists against plain Python, with a group that holds most rows."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from tidecrew.plans.running import dense_index, running_totals, sorted_positions


def hot_rows(n=3000, keys=9, seed=1):
    rnd = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        key = 0 if rnd.random() < 0.5 else rnd.randrange(keys)
        order = rnd.randrange(10**rnd.randrange(3, 12))
        if (key, order) not in used:
            used.add((key, order))
            rows.append((key, order, rnd.randrange(100)))
    return rows


def expected_totals(rows):
    out = {}
    for key in {k for k, _, _ in rows}:
        group = sorted((o, v) for k, o, v in rows if k == key)
        for (order, _), total in zip(group, accumulate(v for _, v in group)):
            out[key, order] = total
    return out


def test_running_totals_at_every_level(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, o long, v long")
    want = expected_totals(rows)
    for levels in (1, 2, 3):
        got = running_totals(df, ["k"], "o", {"total": F.col("v")}, block=64, levels=levels)
        assert {(r.k, r.o): r.total for r in got.collect()} == want


def test_dense_index_numbers_distinct_values(spark):
    df = spark.createDataFrame([(v,) for v in (5, 90000, 5, 7, 10**12, 7)], "v long")
    assert {r["v"]: r["index"] for r in dense_index(df, "v").collect()} == {5: 0, 7: 1, 90000: 2, 10**12: 3}


def test_sorted_positions_spans_partitions(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(16)
    got = sorted_positions(df, ["k"], [F.desc("v"), F.col("o")], "place")
    want = {}
    for key in {k for k, _, _ in rows}:
        for place, (_, order) in enumerate(sorted((-v, o) for k, o, v in rows if k == key), 1):
            want[key, order] = place
    assert {(r.k, r.o): r.place for r in got.collect()} == want
