"""Blocks against blocks: every pair of rows is seen once, and meeting stores and shuffles nothing more."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from micro import micro_tables, values

from tidecrew.operators import closest, similar
from tidecrew.plans.blockwise import met, packed


@pytest.mark.parametrize("blocks", [(1, 1), (3, 5), (40, 2)])
def test_every_pair_of_rows_meets_once_without_a_shuffle(spark, blocks):
    def all_pairs(one, two):
        both = [(a, b) for a in one for b in two]
        return pa.table({"a": pa.array([a for a, _ in both], pa.int64()), "b": pa.array([b for _, b in both], pa.int64())})

    sides = [packed(spark.range(n), "id", b, lambda rows: rows["id"].to_pylist()) for n, b in zip((17, 9), blocks, strict=True)]
    assert all(side.count() <= b == side.rdd.getNumPartitions() for side, b in zip(sides, blocks, strict=True))
    found = met(*sides, all_pairs, "a long, b long")
    assert Counter(values(found)) == Counter((a, b) for a in range(17) for b in range(9))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    none = packed(spark.range(0), "id", 2, lambda rows: rows["id"].to_pylist())
    assert met(none, sides[1], all_pairs, "a long, b long").count() == 0


def test_purchase_counts_are_not_copied_for_every_block(spark, monkeypatch):
    """The counts were dealt out once for every block of the other side."""
    plans = []

    def watched(*args):
        found = met(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(closest, "met", watched)
    monkeypatch.setattr(closest, "ENTRIES", 10)
    monkeypatch.setattr(closest, "LEAST_ENTRIES", 5)
    rnd = random.Random(3)
    t = micro_tables(spark, purchases=[{"id": i, "user_id": rnd.randrange(1, 30), "product_id": rnd.randrange(1, 9)} for i in range(90)])
    assert closest.similar_users_of_all(t).groupBy("target").count().filter("count <> 5").count() == 0
    assert plans and "Exchange" not in plans[0] and "Generate explode" not in plans[0]


def test_offers_with_unknown_products_and_users(spark):
    """A purchase without a product takes its place in the ranking and is not approved; one without a user is nobody's."""
    bought = [(1, 1), (1, 2), (1, None), (2, 1), (2, 2), (2, None), (2, None), (2, 4), (2, 4), (2, 5), (3, 1), (None, 1), (None, 7)]
    t = micro_tables(
        spark,
        products=[{"id": p} for p in range(1, 8)],
        purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(bought)],
    )
    people = spark.createDataFrame([(1,), (3,), (None,)], "user_id long")
    alike = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 1)], "target long, user_id long")
    rows = values(similar.cf_recommendations_of(t, people, n=2, alike=alike), "target", "type", "product_id", "weight")
    # For user 1 the products of user 2 are 4 and the unknown one, twice each, and 5; for user 3 those of user 1 are 2 and the unknown one.
    assert sorted(r for r in rows if r[0]) == [(1, "personalized", 4, 2), (3, "personalized", 2, 1)]
