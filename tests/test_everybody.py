"""Similar users for everybody, nearest places and search tables against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from micro import micro_tables, values
from pyspark.sql import functions as F

from tidecrew.operators import closest, marketplace, nearest, searching, similar


def cosines(bought, k):
    """The k nearest users of every user, by comparing all pairs."""
    vectors = defaultdict(Counter)
    for user, product in bought:
        vectors[user][product] += 1
    norm = {u: sum(n * n for n in v.values()) for u, v in vectors.items()}
    out = []
    for a in vectors:
        rows = []
        for b in vectors:
            dot = sum(n * vectors[b][p] for p, n in vectors[a].items())
            rows.append((b != a, -float(dot) * dot / norm[b], b, dot))
        out += [(a, i, b, dot, norm[b], -c) for i, (_, c, b, dot) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def drawn(seed, users, products, purchases):
    """Purchases with products that nearly everybody buys, equal users, and a user who buys everything."""
    rnd = random.Random(seed)
    bought = [(u, p) for u in range(1, users) for p in (1, 2) if rnd.random() < 0.8]
    bought += [(rnd.randrange(1, users), min(int(rnd.paretovariate(0.6)), products)) for _ in range(purchases)]
    bought += [(users + k, p) for k in range(5) for p in (1, 2, 2)] + [(users + 9, p) for p in range(1, products + 1)]
    return bought + [(users + 20, products + 50), (users + 21, products + 51)]


@pytest.mark.parametrize("light,pairs,entries", [(256, 1 << 21, 1 << 20), (3, 1 << 21, 100), (3, 50, 60), (0, 20, 1 << 20), (40, 1, 300)])
def test_nearest_users_equal_brute_force(spark, monkeypatch, light, pairs, entries):
    monkeypatch.setattr(closest, "LIGHT", light)
    monkeypatch.setattr(closest, "PAIRS", pairs)
    bought = drawn(light, 60, 30, 250)
    counts = Counter(bought)
    user, product, n = (np.array(x, dtype=np.int64) for x in zip(*[(u, p, n) for (u, p), n in counts.items()], strict=True))
    # Within tasks: the shards cover all users, and the best over them are the best of all.
    rnd = np.random.default_rng(light)
    shard_number, names = rnd.integers(0, 3, user.max() + 1), np.unique(user)
    found = defaultdict(list)
    norm = Counter()
    for (u, _), m in counts.items():
        norm[u] += m * m
    for s in range(3):
        own = shard_number[user] == s
        shard = closest.shard_of(user[own], product[own], n[own], 5)
        target, other, dot = closest.nearest_in(shard, user, product, n, 4)
        for t, o, d in zip(target.tolist(), shard.ids[other].tolist(), dot.tolist(), strict=True):
            found[t].append((-float(d) * d / norm[o], o, d))
    want = defaultdict(list)
    for a, i, b, dot, _, _ in cosines(bought, len(names)):
        if i > 1 and dot > 0 and len(want[a]) < 4:
            want[a].append((b, dot))
    for u in names.tolist():
        assert [(o, d) for _, o, d in sorted(found[u])[:4]] == want[u], u
    monkeypatch.setattr(closest, "ENTRIES", entries)
    monkeypatch.setattr(closest, "LEAST_ENTRIES", 50)
    t = micro_tables(spark, purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(bought)])
    rows = closest.similar_users_of_all(t).select("target", "position", "user_id", "dot", "norm", "closeness")
    assert sorted(values(rows)) == cosines(bought, 5)


def test_a_product_that_everybody_buys_costs_a_pattern():
    users = 50_000
    user = np.repeat(np.arange(users), 2)
    product = np.stack([np.zeros(users, dtype=np.int64), 1 + np.arange(users) // 3], axis=1).ravel()
    n = np.ones(len(user), dtype=np.int64)
    shard = closest.shard_of(user, product, n, 5)
    assert len(shard.members.start) - 1 == 1 and len(shard.by_product.owner) == 1
    target, other, dot = closest.nearest_in(shard, user, product, n, 4)
    assert len(target) == 4 * users
    # Two neighbours share both products, and the rest of the list is filled from the lowest ids.
    first = dot.reshape(users, 4)
    assert (first[:-2, :2] == 2).all() and (first[:, 2:] == 1).all() and set(other.reshape(users, 4)[10:-2, 2].tolist()) == {0}


def test_offers_for_all_equal_those_for_a_cohort(spark):
    rnd = random.Random(6)
    bought = [(rnd.randrange(1, 9), rnd.randrange(1, 12)) for _ in range(40)] + [(20, 30)]
    t = micro_tables(
        spark,
        products=[{"id": p, "status": "Approved" if p % 3 else "Pending"} for p in [*range(1, 12), 30]],
        purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(bought)],
    )
    people = spark.createDataFrame([(u,) for u in (1, 2, 3, 20, 98)], "user_id long")
    columns = ("target", "type", "product_id", "weight")
    got = similar.cf_recommendations_of(t, people, alike=closest.similar_users_of_all(t))
    assert sorted(values(got, *columns)) == sorted(values(similar.cf_recommendations_of(t, people), *columns))


def plain_nearest(points, places, within):
    def km(a, b):
        a, b = [[math.radians(x) for x in p] for p in (a, b)]
        half = math.sin((b[0] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(b[0]) * math.sin((b[1] - a[1]) / 2) ** 2
        return round(2 * nearest.RADIUS * math.asin(min(1, math.sqrt(half))), 6)

    out = []
    for p in set(points):
        if None in p or any(math.isnan(x) for x in p):
            continue
        rows = [(km(p, q[:2]), q[2]) for q in places if None not in q and abs(q[0]) <= 90 and abs(p[0]) <= 90]
        best = min((r for r in rows if r[0] <= within), default=(None, None))
        out.append((*p, best[1], best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("within,blocks", [(25.0, None), (300.0, (7, 11)), (0.5, None), (3000.0, (5, 4))])
def test_nearest_places_equal_full_comparison(spark, monkeypatch, within, blocks):
    if blocks:
        monkeypatch.setattr(nearest, "PLACES", blocks[0])
        monkeypatch.setattr(nearest, "POINTS", blocks[1])
    rnd = random.Random(int(within))
    spot = lambda: (round(rnd.uniform(-90, 90), 3), round(rnd.uniform(-180, 180), 3))
    near = lambda p, d: (round(p[0] + rnd.uniform(-d, d), 4), round(p[1] + rnd.uniform(-d, d), 4))
    city, pole, edge = (48.2, 16.4), (89.9, 12.0), (10.0, 179.99)
    places = [(*spot(), f"p{k}") for k in range(60)] + [(*near(city, 0.05), f"c{k}") for k in range(60)]
    places += [(89.95, -168.0, "over the pole"), (10.0, -179.99, "over the line"), (*city, "z"), (*city, "a"), (5.0, 5.0, None), (91.0, 0.0, "nowhere")]
    points = [spot() for _ in range(40)] + [near(city, 0.4) for _ in range(60)] + [city, pole, edge, city, (None, 1.0), (95.0, 1.0), (0.0, -0.0), (float("nan"), 1.0)]
    asked = spark.createDataFrame(points, "latitude double, longitude double").withColumn("display_name", F.lit("x"))
    stood = spark.createDataFrame(places, "latitude double, longitude double, display_name string")
    got = nearest.nearest_places(asked, stood, within).collect()
    have = sorted(((r.latitude + 0.0, r.longitude + 0.0, r.display_name, r.distance_km) for r in got), key=str)
    want = plain_nearest([tuple(None if x is None else x + 0.0 for x in p) for p in points], places, within)
    assert [r[:3] for r in have] == [r[:3] for r in want]
    assert all((a[3] is None and b[3] is None) or a[3] == pytest.approx(b[3], abs=2e-6) for a, b in zip(have, want, strict=True))
    assert {r.display_name for r in nearest.nearest_places(asked, stood.limit(0), within).collect()} == {None}
    assert nearest.nearest_places(asked.limit(0), stood, within).collect() == []


TERMS = [" Bolt ", "b_lt%", "bolt\\", "", None, "%", "__", "zz", "o", "Ol", "%ste%l_", "a%b%c", "x_y_z_", "ÉTÉ", "bolt", "\t"]


def test_search_table_equals_single_searches(spark, small):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string").withColumn("id", F.lit(1))
    found = defaultdict(list)
    for r in searching.term_matches(small, terms).collect():
        found[r.term].append((r.id, r.purchase_count))
    best = defaultdict(list)
    for r in searching.term_recommendations(small, terms).collect():
        best[r.term].append((r.position, r.id, r.score))
    for term in {(t or "").strip().lower() for t in TERMS}:
        want = values(marketplace.product_search(small, term), "id", "purchase_count")
        assert sorted(found[term]) == sorted(want), term
        top = values(marketplace.search_recommendations(small, term), "id", "score")
        assert [r[1:] for r in sorted(best[term])] == top, term
    assert set(found) <= {(t or "").strip().lower() for t in TERMS}


def test_no_term_meets_all_products_but_one_of_signs(spark, small):
    terms = spark.createDataFrame([("steel",), ("o",), ("%el%bolt",)], "term string")
    runs = {r.term: sorted(r.runs) for r in searching.wanted_terms(terms).select("term", searching.term_runs(F.col("term")).alias("runs")).collect()}
    assert runs["steel"] == ["", "eel", "ste", "tee"] and runs["o"] == ["", "o"] and runs["%el%bolt"] == ["", "bol", "el", "olt"]
    plan = searching.term_matches(small, terms)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_shard_does_not_sort_the_asking_users_or_the_pairs_by_place(monkeypatch):
    """Each meeting of a block and a shard sorted the block anew, by user and by product, and the places of all pairs five times over."""
    rnd = np.random.default_rng(3)
    user, product = (np.sort(rnd.integers(0, n, 60_000)) for n in (6_000, 20_000))
    product, n = rnd.permutation(product), rnd.integers(1, 4, 60_000)
    shard, block = closest.shard_of(user, product, n, 5), closest.asking_of(user, product, n)
    sorts = []
    for name in ("lexsort", "argsort", "unique"):
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda keys, *rest, real=real, **given: sorts.append(np.shape(keys)[-1]) or real(keys, *rest, **given))
    target, other, dot = closest.nearest_to(shard, block, 4)
    # The chosen few alone.
    assert len(target) == len(set(zip(target.tolist(), other.tolist(), strict=True))) and max(sorts) <= len(target)
    assert len(target) > 20_000 and dot.min() > 0


def test_sums_of_large_keys():
    """Keys and values that do not fit one number together."""
    key, value = np.array([1 << 60, 3, 1 << 60, 3, 4]), np.array([1 << 40, 2, 1, 5, 0])
    found = closest._summed(key, value)
    assert [x.tolist() for x in found] == [[3, 4, 1 << 60], [7, 0, (1 << 40) + 1]]
    assert [x.tolist() for x in closest._summed(key[1:4:2], value[1:4:2])] == [[3], [7]]
