"""Head places are written out by many tasks, and their lookup is made with the bought head products only."""

from micro import micro_tables, values

from tidecrew.operators import recommend


def test_users_are_spread_out_before_their_head_places(spark):
    """Small partitions of users were merged into one task, which wrote out all head places."""
    t = micro_tables(
        spark,
        products=[{"id": p, "category": "ab"[p % 2]} for p in range(1, 60)],
        purchases=[{"id": u * 100 + p, "user_id": u, "product_id": p} for u in range(1, 20) for p in range(1, u % 5 + 2)],
    )
    users = spark.range(1, 25).selectExpr("id as user_id", "0L as user_band")
    scores = spark.range(1, 60).selectExpr("0L as user_band", "id as product_id", "if(id % 2 = 0, 'a', 'b') as category", "1 + id / 100d as base")
    found = recommend.top_recommendations(t, users, scores)
    rows = values(found, "user_id", "position", "product_id")
    assert len(rows) == 240 and not {(u, p) for u, _, p in rows} & {(u, p) for u in range(1, 20) for p in range(1, u % 5 + 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("xxhash64(user_id" in line and "REPARTITION_BY_NUM" in line for line in plan.split("\n"))
