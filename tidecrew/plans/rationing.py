"""Who gets scarce stock when many ask in one batch.

Requests are served one after the other, and one that does not fit takes nothing.  Whether a request fits depends on
the fate of those before it, which looks sequential.  It is solved in rounds that each run distributed: a request is
surely served if it fits even when every undecided one before it is served, and surely turned down if it does not fit
next to those surely served.  The first undecided request of a product is always decided, so the rounds end with
exactly the one-after-the-other outcome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrew.plans.durable import cut
from tidecrew.plans.running import running_totals


def ration(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Decide every ``unit`` of ``lines`` (unit, product_id, quantity; unique per unit and product) in unit order.

    A unit is served only if each of its lines is.  ``stock`` is (product_id, stock); a line without known stock fails.
    Returns (unit, served).
    """
    state = cut(
        lines.join(stock, "product_id", "left").select(
            "unit",
            "product_id",
            "quantity",
            "stock",
            F.coalesce(F.col("quantity") > F.col("stock"), F.lit(True)).alias("hopeless"),
            F.lit(None).cast("boolean").alias("served"),
        )
    )
    hopeless = state.groupBy("unit").agg(F.max("hopeless").alias("hopeless")).filter("hopeless").select("unit")
    decided = [hopeless.withColumn("served", F.lit(False))]
    # ``before`` is what was served of the product to earlier units and is out of the table; ``served`` marks lines of the last round.
    state = cut(state.join(hopeless, "unit", "left_anti").drop("hopeless").withColumn("before", F.lit(0).cast("bigint")))
    undecided = not state.isEmpty()
    while undecided:
        totals = running_totals(
            state,
            ["product_id"],
            "unit",
            {"new": F.when(F.col("served"), F.col("quantity")).otherwise(0), "most": F.col("quantity")},
        )
        waiting = totals.filter(F.col("served").isNull()).withColumn("sure", F.col("before") + F.col("new")).drop("new", "served")
        fits = F.col("before") + F.col("most") <= F.col("stock")
        fails = F.col("sure") + F.col("quantity") > F.col("stock")
        judged = waiting.withColumns({"fits": fits, "fails": fails})
        ruled = judged.groupBy("unit").agg(F.min("fits").alias("fits"), F.max("fails").alias("fails"))
        ruling = F.when(F.col("fits"), True).when(F.col("fails"), False)
        judged = cut(judged.drop("fits", "fails", "most").join(ruled.select("unit", ruling.alias("served")), "unit"))
        decided.append(judged.filter(F.col("served").isNotNull()).select("unit", "served").distinct())
        # Lines turned down are out, and those just served only matter where somebody still waits.
        still = judged.filter(F.col("served").isNull()).select("product_id").distinct()
        undecided = not still.isEmpty()
        state = (
            judged.filter(F.col("served").isNull() | F.col("served"))
            .withColumn("before", F.col("sure"))
            .drop("sure")
            .join(still, "product_id", "left_semi")
        )
    return reduce(DataFrame.unionByName, decided)
