"""Recommendations against brute force over all pairs, with buyers who own nearly everything."""

import random
from collections import Counter, defaultdict

import pytest
from micro import micro_tables, values
from pyspark.sql import functions as F

from tidecrew.operators import recommend, similar, training
from tidecrew.operators.boosted import Settings


def brute_force(users, products, scores, bought, boosts, n=10):
    """The ranking rule applied to every pair of user and product."""
    out = {}
    for user, band in users:
        seen, rows = set(), []
        for pid in sorted(products):
            if (user, pid) in bought:
                continue
            category, base = products[pid], scores[band, pid]
            score = base
            if (user, category) in boosts:
                score *= boosts[user, category] + 1
            if category in seen:
                score *= 0.95
            seen.add(category)
            rows.append((-score, -base, pid))
        for position, (_, _, pid) in enumerate(sorted(rows)[:n], 1):
            out[user, position] = pid
    return out


@pytest.mark.parametrize(
    "seed,head,near,run,sent", [(1, 6, 64, 1024, 200_000), (2, 2, 2, 2, 200_000), (3, 2, 1, 3, 200_000), (4, 2, 64, 2, 0)]
)
def test_top_recommendations_equal_brute_force(spark, monkeypatch, seed, head, near, run, sent):
    monkeypatch.setattr(recommend, "HEAD_ROWS", sent)
    monkeypatch.setattr(recommend, "HEAD", head)
    monkeypatch.setattr(recommend, "NEAR_STEPS", near)
    monkeypatch.setattr(recommend, "RUN", run)
    rnd = random.Random(seed)
    products = {p: rnd.choice(["wholesale", "recycled"]) for p in range(1, 161)}
    users = [(u, u % 2) for u in range(100, 112)]
    scores = {(b, p): rnd.randrange(10, 40) / 8 for b in (0, 1) for p in products}
    bought = set()
    for user, _ in users:
        # Some buyers take everything from the lowest ids or the best scores on.
        if user % 4 == 0:
            bought |= {(user, p) for p in range(1, rnd.randrange(5, 158))}
        elif user % 4 == 1:
            best = sorted(products, key=lambda p: -scores[user % 2, p])
            bought |= {(user, p) for p in best[: rnd.randrange(5, 158)]}
        else:
            bought |= {(user, rnd.choice(list(products))) for _ in range(20)}
    pairs = sorted(bought)
    t = micro_tables(
        spark,
        products=[{"id": p, "category": c} for p, c in products.items()],
        purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(pairs)],
        product_feedback=[
            {"id": i, "purchase_history_id": i, "user_id": u, "product_id": p, "rating": 1 + i % 5}
            for i, (u, p) in enumerate(pairs)
            if i % 3 == 0
        ],
    )
    boosts = {(r.user_id, r.category): r.boost for r in recommend.category_boost(t).collect()}
    got = recommend.top_recommendations(
        t,
        spark.createDataFrame(users, "user_id long, user_band long"),
        spark.createDataFrame(
            [(b, p, products[p], s) for (b, p), s in scores.items()],
            "user_band long, product_id long, category string, base double",
        ),
    )
    rows = {(r.user_id, r.position): r.product_id for r in got.collect()}
    assert rows == brute_force(users, products, scores, bought, boosts)
    assert not {(u, p) for (u, _), p in rows.items()} & bought


def test_boost_follows_rating_then_count(spark):
    t = micro_tables(
        spark,
        products=[{"id": 1, "category": "a"}, {"id": 2, "category": "b"}, {"id": 3, "category": "c"}],
        purchases=[{"id": i, "user_id": 1, "product_id": p} for i, p in enumerate((1, 2, 2, 3))],
        product_feedback=[{"id": 1, "purchase_history_id": 3, "user_id": 1, "product_id": 3, "rating": 5}],
    )
    rows = sorted(values(recommend.category_boost(t), "place", "category", "boost"))
    assert [r[1] for r in rows] == ["c", "b", "a"]
    assert [round(r[2], 6) for r in rows] == [1.2, 0.8, 0.5]


def test_branches(spark):
    t = micro_tables(
        spark,
        users=[{"id": u} for u in (1, 2, 3, 4)],
        products=[{"id": 1}, {"id": 2, "status": "Pending"}],
        purchases=[
            {"id": 1, "user_id": 1, "product_id": 2},
            {"id": 2, "user_id": 2, "product_id": 1},
        ],
        product_feedback=[
            {"id": 1, "purchase_history_id": 1, "user_id": 1, "product_id": 2, "rating": 4},
            {"id": 2, "purchase_history_id": 2, "user_id": 2, "product_id": 1, "rating": 4},
            {"id": 3, "purchase_history_id": 2, "user_id": 3, "product_id": 1, "rating": 4},
        ],
    )
    kinds = dict(values(recommend.recommendation_type(recommend.candidate_counts(t))))
    assert kinds == {
        1: "personalized",
        2: "general_fallback",
        3: "popularity_no_history",
        4: "popularity_fallback_new_user",
    }
    assert values(recommend.candidates_for(t, 1), "product_id") == [(1,)]
    assert values(recommend.candidates_for(t, 2), "product_id") == []
    users = spark.createDataFrame([(u, 0) for u in (1, 2, 3)], "user_id long, user_band long")
    rows = sorted(values(recommend.recommendations(t, users, training.mean_scores(t)), "user_id", "product_id"))
    assert rows == [(1, 1), (2, 1), (3, 1), (4, 1)]
    # Without a band there is no personal list; the last resort takes its place.
    strangers = users.filter("user_id <> 1")
    rows = values(recommend.recommendations(t, strangers, training.mean_scores(t)), "user_id", "type", "position", "product_id")
    assert (1, "final_fallback", 1, 1) in rows and len(rows) == 4


def test_the_last_resort_is_a_long_list(spark):
    products = [{"id": p} for p in range(1, 31)]
    t = micro_tables(
        spark,
        users=[{"id": 7}, {"id": 8}],
        products=products,
        purchases=[{"id": 1, "user_id": 7, "product_id": 1}],
        product_feedback=[
            {"id": 1, "purchase_history_id": 1, "user_id": 7, "product_id": p, "rating": 4} for p in range(1, 4)
        ],
    )
    nobody = spark.createDataFrame([], "user_id long, user_band long")
    rows = values(recommend.recommendations(t, nobody, training.mean_scores(t)), "user_id", "type", "position", "product_id")
    want = sorted(range(1, 31), key=lambda p: (p * 7 % 100, p))[:10]
    assert sorted(r[2:] for r in rows if r[:2] == (7, "final_fallback")) == list(enumerate(want, 1))
    # User 8 is unknown: the products somebody bought.
    assert [r for r in rows if r[0] == 8] == [(8, "popularity_fallback_new_user", 1, 1)]


def test_price_bands_are_right_closed_quantiles(spark):
    import numpy as np
    import pandas as pd

    rnd = random.Random(4)
    cents = [rnd.choice([500, 700, 900, 1100, 1300, rnd.randrange(100, 5000)]) for _ in range(200)]
    df = spark.createDataFrame([(c / 100,) for c in cents], "p double").select(F.col("p").cast("decimal(10,2)").alias("price"))
    edges = training.price_edges(df)
    want = pd.qcut(pd.Series(cents), q=5, labels=False, duplicates="drop").tolist()
    got = [max(sum(c * 5 > e for e in edges) - 1, 0) for c in cents]
    assert got == want
    assert np.allclose([e / 5 for e in edges], sorted(set(np.quantile(cents, [0, 0.2, 0.4, 0.6, 0.8]))))


def test_similar_users_match_cosine(spark):
    rnd = random.Random(5)
    bought = [(rnd.randrange(1, 9), rnd.randrange(1, 12)) for _ in range(80)]
    t = micro_tables(
        spark,
        products=[{"id": p, "status": "Approved" if p % 3 else "Pending"} for p in range(1, 12)],
        purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(bought)],
    )
    vectors = defaultdict(Counter)
    for u, p in bought:
        vectors[u][p] += 1

    def cosine2(a, b):
        dot = sum(n * vectors[b][p] for p, n in vectors[a].items())
        return dot * dot / sum(n * n for n in vectors[b].values())

    want = sorted(vectors, key=lambda u: (u != 3, -cosine2(3, u), u))[:5]
    assert [r.user_id for r in similar.similar_users(t, 3).collect()] == want
    weights = Counter(p for u, p in bought if u in want[1:] and p not in vectors[3])
    if weights:
        top = [p for p, _ in sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:5] if p % 3]
        rows = values(similar.cf_recommendations(t, 3), "type", "product_id")
        assert sorted(rows) == sorted(("personalized", p) for p in top) or not top
    # Somebody unknown is offered what sells best.
    best = [p for p, _ in sorted(Counter(p for _, p in bought).items(), key=lambda x: (-x[1], x[0]))[:5] if p % 3]
    assert sorted(values(similar.cf_recommendations(t, 99), "type", "product_id")) == sorted(("popular", p) for p in best)


def test_model_is_stored_and_repeatable(spark, small, tmp_path):
    frame = training.model_frame(small)
    model = training.rating_model(frame, Settings(rounds=2, depth=3))
    training.save_model(model, training.model_metadata(small), str(tmp_path))
    loaded, metadata = training.load_model(spark, str(tmp_path))
    assert metadata.first()["num_classes"] == 5
    ratings = [1, 2, 3, 4, 5]
    first = {(r.user_band, r.product_id): r.base for r in training.model_scores(small, model, ratings).collect()}
    again = {(r.user_band, r.product_id): r.base for r in training.model_scores(small, loaded, ratings).collect()}
    assert first == again and all(1 <= x <= 5 for x in first.values())
    assert len(first) == training.USER_BANDS * training.serving_features(small).count()


def test_a_long_list_is_complete(spark):
    products = [{"id": p, "category": "wholesale"} for p in range(1, 60)]
    t = micro_tables(spark, products=products)
    users = spark.createDataFrame([(1, 0)], "user_id long, user_band long")
    scores = spark.createDataFrame(
        [(0, p, "wholesale", float(p)) for p in range(1, 60)], "user_band long, product_id long, category string, base double"
    )
    rows = recommend.top_recommendations(t, users, scores, n=30).collect()
    assert sorted(r.position for r in rows) == list(range(1, 31))


def test_a_cohort_gets_what_each_user_gets_alone(spark):
    rnd = random.Random(6)
    bought = [(rnd.randrange(1, 9), rnd.randrange(1, 12)) for _ in range(40)]
    # User 20 shares nothing with anybody, user 21 holds all best sellers, users 98 and 99 have no purchases.
    best = [p for p, _ in sorted(Counter(p for _, p in bought).items(), key=lambda x: (-x[1], x[0]))[:5]]
    bought += [(20, 30)] + [(21, p) for p in best]
    t = micro_tables(
        spark,
        products=[{"id": p, "status": "Approved" if p % 3 else "Pending"} for p in [*range(1, 12), 30]],
        purchases=[{"id": i, "user_id": u, "product_id": p} for i, (u, p) in enumerate(bought)],
    )
    people = [1, 2, 3, 20, 21, 98, 99, 99]
    cohort = spark.createDataFrame([(u,) for u in people], "user_id long")
    alike = values(similar.similar_users_of(t, cohort).orderBy("target", "position"), "target", "user_id", "closeness")
    offers = values(similar.cf_recommendations_of(t, cohort), "target", "type", "product_id", "weight")
    for user in sorted(set(people)):
        alone = values(similar.similar_users(t, user), "user_id", "closeness") if user < 98 else []
        assert [r[1:] for r in alike if r[0] == user] == alone
        assert sorted(r[1:] for r in offers if r[0] == user) == sorted(values(similar.cf_recommendations(t, user)))


def test_model_losses_by_side_and_number_of_bands(spark, small):
    judged = spark.createDataFrame(
        [("test", 0.0, [0.5, 0.5]), ("test", 1.0, [0.5, 0.5]), ("train", 1.0, [1.0, 0.0])],
        "side string, label double, shares array<double>",
    )
    rows = {r.side: (r.ratings, r.mlogloss, r.accuracy) for r in training.rating_losses(judged).collect()}
    assert rows == {"test": (2, 0.693147, 0.5), "train": (1, 34.538776, 0.0)}
    frame = training.model_frame(small, bands=64)
    model = training.rating_model(frame, Settings(rounds=3, depth=3))
    losses = {r.side: r.mlogloss for r in training.model_losses(model, frame).collect()}
    best = min(model.history, key=lambda h: h[2])
    assert len(model.trees) == best[0] and losses["test"] == pytest.approx(best[2], abs=1e-6)
    assert losses["train"] == pytest.approx(best[1], abs=1e-6)
    scores = training.model_scores(small, model, training.stored_ratings(training.model_metadata(small)), bands=64)
    assert scores.select("user_band").distinct().count() == 64
