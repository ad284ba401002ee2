"""Small plan-building blocks shared by the reports."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side: a union and one aggregate, so no join of any kind is planned."""
    columns = [name for frame in frames for name in frame.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(name).alias(name) for name in columns])


def all_of(predicates: Iterable[Column | None]) -> Column:
    """The conjunction of the predicates that were given."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def sorted_if(df: DataFrame, ordered: bool, *order: Column | str) -> DataFrame:
    """A whole report in display order.

    A global sort is a range-partitioned shuffle; every order given here ends in a unique key, so rows that share a
    date or an owner still spread over the tasks.  Callers that only write the rows out pass ``ordered=False``.
    """
    return df.orderBy(*order) if ordered else df


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``rows`` rows; otherwise leave the choice to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_for(spark: SparkSession) -> int:
    """Partitions that keep all cores busy."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_out(df: DataFrame, key: str | Column) -> DataFrame:
    """``df`` over all cores by ``key``, for rows that are few in bytes but much work each.

    The number is given outright, so that small partitions are not merged again at run time.
    """
    return df.repartition(parts_for(df.sparkSession), key)
