"""Offers by factors against whole tables of scores."""

import random

import numpy as np
import pyarrow as pa
import pytest
from micro import micro_tables, values

from tidecrew.operators import similar


def test_best_offers_equal_all_inner_products(monkeypatch):
    """Whole tables of scores against the search that stops by length; vectors of one length, equal ones and zeros among them."""
    monkeypatch.setattr(similar, "TOGETHER", 7)
    monkeypatch.setattr(similar, "STEP", 5)
    monkeypatch.setattr(similar, "FIRST_STEP", 3)
    rnd = np.random.default_rng(5)
    for spread in (0, 0.1, 2):
        vectors = [rnd.integers(-4, 5, (count, 3)) * np.exp2(np.floor(rnd.normal(0, spread, (count, 1)))) for count in (40, 90)]
        vectors[0][:2] = vectors[1][:2] = 0
        vectors[1][10:20] = vectors[1][10]
        sides = [
            similar.Factors.of(pa.table({"id": pa.array(range(len(v)), pa.int32()), "features": pa.array(v.tolist(), pa.list_(pa.float32()))}))
            for v in vectors
        ]
        rows = similar.best_offers(*sides, 4).to_pydict()
        table = vectors[0] @ vectors[1].T
        for user in range(40):
            own = sorted((i for i, u in enumerate(rows["user"]) if u == user), key=lambda i: -rows["score"][i])
            assert [rows["score"][i] for i in own] == sorted(table[user], reverse=True)[:4], user
            assert len({rows["product"][i] for i in own}) == 4
            assert all(table[user, rows["product"][i]] == rows["score"][i] for i in own)
    few = similar.Factors(*[x[:2] for x in sides[1]])
    assert len(similar.best_offers(sides[0], few, 4)) == 80


def test_offers_by_factors_do_not_compare_all_pairs(monkeypatch):
    """Every user was compared with every product."""
    rnd = np.random.default_rng(6)
    vectors = np.abs(rnd.normal(0, 1, (20_000, 16))) * rnd.uniform(0.1, 1, (20_000, 1))
    number = np.arange(20_000)
    rows = pa.table({"id": pa.array(number, pa.int32()), "features": pa.array(list(vectors), pa.list_(pa.float32()))})
    factors = similar.Factors.of(rows)
    seen = []
    counted = type("Counted", (np.ndarray,), {"__getitem__": lambda self, key: (seen.append(key), np.ndarray.__getitem__(self, key))[1]})
    users = similar.Factors(*[x[:100] for x in factors])
    similar.best_offers(users, factors._replace(vector=factors.vector.view(counted)), 5)
    assert max(key.start for key in seen if isinstance(key, slice)) < 10_000


def test_factor_recommendations_equal_the_model(spark):
    """The offers are the model's own, from several blocks on both sides."""
    rnd = random.Random(11)
    bought = [(rnd.randrange(1, 40), rnd.randrange(1, 60)) for _ in range(600)]
    t = micro_tables(spark, purchases=[{"id": i, "user_id": u * 1000, "product_id": p * 10} for i, (u, p) in enumerate(bought)])
    got = values(similar.factor_recommendations(t, rank=4, rounds=3), "user_id", "position", "product_id", "score")
    model = similar.factor_model(t, rank=4, rounds=3)
    names = sorted({u * 1000 for u, _ in bought})
    want = {names[r.user]: [o.rating for o in r.recommendations] for r in model.recommendForAllUsers(5).collect()}
    assert len(got) == 5 * len(names)
    for user in names:
        own = sorted(r[1:] for r in got if r[0] == user)
        assert [p for p, _, _ in own] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in own] == pytest.approx(want[user], rel=1e-3)


def test_blocks_of_the_learner_and_of_factors_are_bounded(spark, monkeypatch):
    """The learner held any number of pairs in ten blocks and the shuffles of five rounds; a block of factors had a million."""
    made, als = [], similar.ALS
    monkeypatch.setattr(similar, "LEARNT", 4)
    monkeypatch.setattr(similar, "ALS", lambda **given: made.append(given) or als(**given))
    t = micro_tables(spark, purchases=[{"id": i, "user_id": i % 9, "product_id": i % 7} for i in range(63)])
    assert len(values(similar.factor_recommendations(t, n=2, rank=2, rounds=2))) == 18
    assert {(m["numUserBlocks"], m["numItemBlocks"], m["checkpointInterval"]) for m in made} == {(16, 16, 1)}
    assert similar.VECTORS * 16 * 4 <= 16 << 20
