"""Tables in parts and in buckets: a change touches what it must and no more."""

import random
from pathlib import Path

import pytest
from micro import micro_tables, values
from pyspark.sql import functions as F

from tidecrew.operators import changes
from tidecrew.plans.parts import store_parts
from tidecrew.sources.catalog import store_bucketed


def files(folder):
    return {str(f) for f in Path(folder).rglob("*.parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id", "id % 7 as n")
    stored = store_parts(rows, str(tmp_path / "t"), "id", parts=50)
    before = files(tmp_path / "t")
    keys = sorted(random.Random(1).sample(range(3_000, 5_000), 20))
    asked = spark.createDataFrame([(k,) for k in keys], "id long")
    stored.change(asked, lambda part: part.join(asked.withColumn("hit", F.lit(1)), "id", "left").selectExpr("id", "if(hit is null, n, -1) as n"))
    after = files(tmp_path / "t")
    touched = {k // stored.width for k in keys}
    part = lambda f: int(Path(f).parent.name.split("=")[1])
    assert {part(f) for f in before - after} == touched == {part(f) for f in after - before}
    assert {f for f in before if part(f) not in touched} <= after
    assert sorted(values(stored.read())) == [(k, -1 if k in keys else k % 7) for k in range(10_000)]


def test_rows_can_come_go_and_lack_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (55, "c"), (None, "d")], "id long, name string")
    stored = store_parts(rows, str(tmp_path / "t"), "id", parts=4)
    stored.change(spark.createDataFrame([(1,), (900,)], "k long"), lambda part: part.filter("id > 2").unionByName(spark.sql("select 900L as id, 'new' as name")))
    assert sorted(values(stored.read()), key=str) == sorted([(55, "c"), (None, "d"), (900, "new")], key=str)
    assert stored.read(spark.createDataFrame([(0,)], "_part long")).count() == 0
    empty = store_parts(rows.limit(0), str(tmp_path / "e"), "id")
    empty.change(spark.createDataFrame([(7,)], "k long"), lambda part: part.unionByName(spark.sql("select 7L as id, 'x' as name")))
    assert values(empty.read()) == [(7, "x")]


def test_a_table_in_buckets_is_not_shuffled(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = micro_tables(spark, drive_volunteers=[{"event_id": e, "volunteer_id": v} for e in range(5) for v in range(40)])
        stored = store_bucketed(t.drive_volunteers, "volunteers_in_buckets", ["event_id", "volunteer_id"], str(tmp_path / "b"), 4)
        requests = spark.createDataFrame([(1, 1, 5), (2, 9, 9), (3, 9, 9)], "request_id long, event_id long, volunteer_id long")
        verdicts = changes.join_drives(t.with_tables(drive_volunteers=stored), requests).verdicts
        plan = verdicts._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "volunteers_in_buckets" in line and "FileScan" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < level:
                above.append(line)
                level = depth(line)
            if "SortMergeJoin" in line and "LeftSemi" in line:
                break
        assert "LeftSemi" in above[-1] and not any("Exchange" in line for line in above)
        assert sorted((r.request_id, r.reason is None) for r in verdicts.collect()) == [(1, False), (2, True), (3, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists volunteers_in_buckets")


@pytest.mark.parametrize("name", ["award_badges"])
def test_missing_keys_get_their_reason(spark, name):
    t = micro_tables(spark, drives=[{"id": 1, "organiser_id": 3}])
    requests = spark.createDataFrame(
        [(1, None, 1, "gold", 3), (2, 5, 1, "gold", 3), (3, 5, 1, "gold", 3), (4, 6, 2, "gold", 3), (5, 7, 1, None, 3)],
        "request_id long, volunteer_id long, event_id long, badge_type string, organiser_id long",
    )
    got = {r.request_id: r.reason for r in getattr(changes, name)(t, requests).verdicts.collect()}
    assert got == {
        1: "Missing required data",
        2: None,
        3: "Badge already awarded",
        4: "Unauthorized or event not completed",
        5: "Missing required data",
    }
