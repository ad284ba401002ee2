"""Plans stay free of pair-building joins, and filters and columns reach the files."""

import pytest
from conftest import SMALL
from micro import values

from tidecrew import registry
from tidecrew.operators import impact, marketplace
from tidecrew.sources.catalog import parquet_catalog, store_catalog
from tidecrew.sources.mapping import benchmark_tables

LAZY = {**registry.IMPACT, **registry.ORGANISERS, **registry.MARKETPLACE}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_report_builds_pairs_or_forces_a_broadcast(spark, small, no_broadcast):
    for name, report in LAZY.items():
        plan = plan_of(report(small))
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BatchEvalPython"):
            assert operator not in plan, (name, operator)


def test_rank_filter_runs_before_the_shuffle(small):
    plan = plan_of(marketplace.latest_feedback(small))
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalogue"))
    names = ("users", "drives", "drive_volunteers", "donations", "products", "purchases")
    store_catalog(benchmark_tables(spark, SMALL), root, names)
    return parquet_catalog(spark, root, names)


def test_stored_catalogue_gives_the_same(stored, small):
    assert values(impact.monthly_stats(stored)) == values(impact.monthly_stats(small))
    assert values(impact.dashboard_stats(stored)) == values(impact.dashboard_stats(small))


def test_filters_and_columns_reach_the_files(stored):
    plan = plan_of(impact.monthly_stats(stored))
    assert "EqualTo(status,Completed)" in plan
    assert "ReadSchema: struct<event_id:bigint,plastics_collected:double>" in plan
    plan = plan_of(impact.completed_buyers(stored))
    assert "EqualTo(status,Completed)" in plan and "total_amount" not in plan
