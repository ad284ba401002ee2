"""Badge discounts and money columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.sources.catalog import Tables

# Badge types from lowest to highest and the discount each one earns, in percent.
BADGE_DISCOUNT = {"bronze": 5, "gold": 10, "platinum": 15, "diamond": 20}
DISCOUNT_LEVELS = (0, *BADGE_DISCOUNT.values())


def badge_rank(badge: Column) -> Column:
    """1 for the lowest badge type upwards, 0 for an unknown one; case does not matter."""
    return F.array_position(F.array(*[F.lit(b) for b in BADGE_DISCOUNT]), F.lower(badge))


def highest_badge(t: Tables) -> DataFrame:
    """Best badge of every volunteer who has one."""
    best = F.max(F.struct(badge_rank(F.col("badge_type")).alias("badge_rank"), F.lower("badge_type").alias("badge")))
    return (
        t.volunteer_badges.groupBy("volunteer_id")
        .agg(best.alias("best"))
        .select("volunteer_id", F.col("best.badge").alias("highest_badge"), F.col("best.badge_rank").alias("badge_rank"))
    )


def badge_discounts(t: Tables) -> DataFrame:
    """Discount of the volunteers who have one: ``user_id``, ``discount_pct``."""
    levels = F.array(*[F.lit(level) for level in DISCOUNT_LEVELS])
    volunteers = t.users.filter(F.col("role") == "volunteer").select(F.col("id").alias("user_id"))
    earned = highest_badge(t).select(
        F.col("volunteer_id").alias("user_id"), F.get(levels, F.col("badge_rank")).alias("discount_pct")
    )
    return earned.filter(F.col("discount_pct") > 0).join(volunteers, "user_id", "left_semi")


def less(price: Column, percent: Column) -> Column:
    """A price less a whole percentage, rounded to cents."""
    return F.round(price * (100 - percent) / 100, 2).cast("decimal(12,2)")


def badge_price(price: Column, percent: Column) -> Column:
    """The badge price, NULL without a discount."""
    return F.when(percent > 0, less(price, percent))
