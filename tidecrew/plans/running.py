"""Running totals and dense numbering that never put a whole group into one task.

A plain window over a group sends the group to a single task.  Here the group is cut into blocks of its order key:
totals per block come from a partially aggregated shuffle, only block totals are accumulated per group, and the window
that touches the rows runs inside a block, which holds at most ``block`` different keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.plans.durable import cut

# Rows of a group that one window task handles at most.
BLOCK = 4096


def running_totals(
    rows: DataFrame,
    groups: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    block: int = BLOCK,
    levels: int = 2,
) -> DataFrame:
    """Add inclusive running sums over ``order`` within ``groups``.

    ``order`` is an integer that is unique within a group; group columns are not NULL; ``totals`` maps new column names
    to summed values.  With n ``levels`` the block totals are cut into blocks again n - 1 times, so the last window sees
    one row per ``block ** n`` keys, however thinly the keys are sown.
    """
    name = f"_block_{levels}"
    keys = [*groups, name]
    cut_up = rows.withColumn(name, F.floor(F.col(order) / block)).withColumns(
        {f"_v_{levels}_{total}": value for total, value in totals.items()}
    )
    sums = cut_up.groupBy(*keys).agg(*[F.sum(f"_v_{levels}_{t}").alias(f"_s_{levels}_{t}") for t in totals])
    if levels > 1:
        up_to = running_totals(
            sums, groups, name, {f"_u_{levels}_{t}": F.col(f"_s_{levels}_{t}") for t in totals}, block, levels - 1
        )
        before = {t: F.col(f"_u_{levels}_{t}") - F.col(f"_s_{levels}_{t}") for t in totals}
    else:
        up_to = sums
        earlier = (
            Window.partitionBy(*groups).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
        )
        before = {t: F.coalesce(F.sum(f"_s_{levels}_{t}").over(earlier), F.lit(0)) for t in totals}
    offsets = up_to.select(*keys, *[before[t].alias(f"_o_{levels}_{t}") for t in totals])
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut_up.withColumns({f"_r_{levels}_{t}": F.sum(f"_v_{levels}_{t}").over(inner) for t in totals})
        .join(offsets, keys)
        .select(*rows.columns, *[(F.col(f"_r_{levels}_{t}") + F.col(f"_o_{levels}_{t}")).alias(t) for t in totals])
    )


def dense_index(values: DataFrame, column: str, groups: Sequence[str] = (), name: str = "index") -> DataFrame:
    """Number distinct integer values 0, 1, 2, ... in ascending order, per group if groups are given."""
    numbered = running_totals(values.select(*groups, column).distinct(), groups, column, {name: F.lit(1)})
    return numbered.withColumn(name, F.col(name) - 1)


def spread(key: Column, parts: Column) -> Column:
    """A repeatable part number for an integer key."""
    return (key % 1000003) * 7919 % 1000003 % parts


def sorted_positions(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of every group 1, 2, 3, ... in the given order, which must end in a unique key.

    The rows are range-partitioned and sorted like any distributed sort, so a group may span many partitions.  They
    are then stored in the shared folder: numbering reads the partition layout twice, and it has to be the same layout
    both times, also after an executor was lost in between.
    """
    keys = [F.col(g) for g in groups]
    numbered = cut(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", 33))
    )
    slices = numbered.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        numbered.join(offsets, [*groups, "_slice"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1)
        .select(*rows.columns, name)
    )
