"""Recommendations for every user at once.

No table of all pairs of user and product is ever built.  What a user can be shown depends on three things that are
each linear in the data: the products in score order, the products the user has bought, and the user's favourite
categories.  The best unbought products of a category lie within the first ``n + 11`` places if the user bought ``n`` of
its products, so only that many places are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.operators.impact import zero
from tidecrew.operators.training import training_set
from tidecrew.plans.combine import broadcast_up_to, spread_out
from tidecrew.plans.durable import cut
from tidecrew.plans.running import running_totals, sorted_positions
from tidecrew.sources.catalog import Tables

# List lengths, boosts and the penalty of the ranking.
PERSONAL = 10
SHORT_LIST = 5
NEUTRAL_RATING = 3
BOOST_STEP, LEAST_BOOST = 0.4, 0.5
REPEAT_PENALTY = 0.95

# Places per category that everybody looks at, besides a full list; heavy buyers look further down in steps of as many.
HEAD = 6
# Largest table of places that is sent to every executor, and the steps it covers.
HEAD_ROWS = 200_000
NEAR_STEPS = 64
# Step numbers written out at a time for one buyer.
RUN = 1024
RESIDUES = 100
LAST_RESORT = "final_fallback"


def bought_pairs(t: Tables) -> DataFrame:
    """Distinct (user, product) pairs of the purchases."""
    return t.purchases.select("user_id", "product_id").distinct()


def candidate_counts(t: Tables) -> DataFrame:
    """Per user: whether the model knows them, and how many products are left to recommend.

    ``available`` counts Approved products not bought yet, ``in_model`` those of them that were rated by anybody.
    """
    rated = training_set(t).select("product_id").distinct().withColumn("rated", F.lit(1))
    approved = (
        t.products.filter(F.col("status") == "Approved")
        .select(F.col("id").alias("product_id"))
        .join(rated, "product_id", "left")
        .select("product_id", zero(F.col("rated")).alias("rated"), F.lit(1).alias("approved"))
    )
    all_approved = approved.agg(F.count(F.lit(1))).scalar()
    all_rated = approved.agg(zero(F.sum("rated"))).scalar()
    bought = (
        bought_pairs(t)
        .join(approved, "product_id", "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("bought"),
            zero(F.sum("approved")).alias("bought_approved"),
            zero(F.sum("rated")).alias("bought_rated"),
        )
    )
    known = training_set(t).select("user_id").distinct().withColumn("known", F.lit(True))
    return (
        t.users.select(F.col("id").alias("user_id"))
        .join(bought, "user_id", "left")
        .join(known, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("known", F.lit(False)).alias("known"),
            zero(F.col("bought")).alias("bought"),
            (all_approved - zero(F.col("bought_approved"))).alias("available"),
            (all_rated - zero(F.col("bought_rated"))).alias("in_model"),
        )
    )


def candidates_for(t: Tables, user_id: int) -> DataFrame:
    """The products one user can be recommended: Approved, rated by anybody, not bought."""
    mine = t.purchases.filter(F.col("user_id") == user_id).select(F.col("product_id").alias("id")).distinct()
    rated = training_set(t).select(F.col("product_id").alias("id")).distinct()
    return (
        t.products.filter(F.col("status") == "Approved")
        .join(mine, "id", "left_anti")
        .join(rated, "id", "left_semi")
        .select(F.col("id").alias("product_id"), "category", "price")
    )


def recommendation_type(counts: DataFrame) -> DataFrame:
    """The branch each user falls into, in the order the checks are made."""
    kind = (
        F.when(~F.col("known"), "popularity_fallback_new_user")
        .when(F.col("bought") == 0, "popularity_no_history")
        .when(F.col("available") == 0, "general_fallback")
        .when(F.col("in_model") == 0, "new_products_fallback")
        .otherwise("personalized")
    )
    return counts.select("user_id", kind.alias("type"))


def category_boost(t: Tables) -> DataFrame:
    """Categories each user bought from, best rated first, with the boost their place earns."""
    listed = t.products.select(F.col("id").alias("product_id"), "category")
    ratings = t.product_feedback.select(F.col("purchase_history_id").alias("id"), "rating")
    stats = (
        t.purchases.select("id", "user_id", "product_id")
        .join(listed, "product_id")
        .join(ratings, "id", "left")
        .groupBy("user_id", "category")
        .agg(
            F.count(F.lit(1)).alias("purchases"),
            F.sum(F.coalesce("rating", F.lit(NEUTRAL_RATING))).alias("rating_sum"),
        )
    )
    # At most one row per category and user from here on.
    best = Window.partitionBy("user_id").orderBy(
        F.desc(F.col("rating_sum") / F.col("purchases")), F.desc("purchases"), "category"
    )
    everything = Window.partitionBy("user_id")
    place = F.row_number().over(best) - 1
    boost = F.greatest(F.lit(LEAST_BOOST), (F.count(F.lit(1)).over(everything) - place) * F.lit(BOOST_STEP))
    return stats.select("user_id", "category", place.alias("place"), boost.alias("boost"))


def top_recommendations(t: Tables, users: DataFrame, scores: DataFrame, n: int = PERSONAL) -> DataFrame:
    """The ``n`` best unbought products of every given user.

    ``users`` has ``user_id`` and ``user_band``; ``scores`` has ``user_band``, ``product_id``, ``category`` and
    ``base``.  A score is the base, boosted by the user's liking of the category, with a small penalty on every product
    of a category but the one with the lowest id among those the user can be shown.
    """
    # Unbought places needed per category: a full list and the one product that is spared the penalty.
    needed = n + 1
    head_size = n + HEAD
    category = F.coalesce("category", F.lit("")).alias("category")
    users = cut(spread_out(users.select("user_id", "user_band"), "user_id"))
    # Stored: the list of products, the sampling of the order and the order itself read it.
    scored = cut(scores.select("user_band", "product_id", category, "base"))
    listed = scored.select("product_id", "category").distinct()
    by_id = sorted_positions(listed, ["category"], [F.col("product_id")], "id_place")
    places = cut(
        sorted_positions(
            scored.join(by_id.select("product_id", "id_place"), "product_id"),
            ["user_band", "category"],
            [F.desc("base"), F.col("product_id")],
            "place",
        )
    )

    # Stored once: the pairs enter the ranking twice and the tastes three times.
    bought = cut(
        bought_pairs(t)
        .join(users.select("user_id"), "user_id", "left_semi")
        .join(by_id, "product_id")
        .select("user_id", "category", "product_id", "id_place")
    )
    # The spared product: the first id place that was not bought.  The j-th bought place equals j just as long as
    # everything before it was bought too.  Who did not buy the very first place needs no running count.
    by_taste = ["user_id", "category"]
    from_first = broadcast_up_to(cut(bought.filter(F.col("id_place") == 1).select(*by_taste)), HEAD_ROWS)
    in_order = running_totals(bought.join(from_first, by_taste, "left_semi"), by_taste, "id_place", {"nth": F.lit(1)})
    spared = in_order.groupBy(*by_taste).agg((F.count_if(F.col("nth") == F.col("id_place")) + 1).alias("spared"))
    taken = (
        bought.groupBy(*by_taste)
        .agg(F.count(F.lit(1)).alias("bought"))
        .join(spared, by_taste, "left")
        .withColumn("spared", F.coalesce("spared", F.lit(1)))
    )
    boosts = category_boost(t).select("user_id", category, "boost").filter(F.col("category") != "")
    taste = cut(
        taken.join(boosts, ["user_id", "category"], "full").select(
            "user_id",
            "category",
            zero(F.col("bought")).alias("bought"),
            F.coalesce("spared", F.lit(1)).alias("spared"),
            "boost",
        )
    )
    # One entry per category: a closed list, so a user's row stays small and the head places join without a shuffle.
    entry = F.struct("category", F.struct("spared", "boost"))
    tastes = taste.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("tastes"))
    columns = ["user_id", "product_id", "category", "base", "id_place", "spared", "boost"]

    head = cut(places.filter((F.col("place") <= head_size) | (F.col("id_place") <= head_size)))
    # Few bytes a user, but a row for every head place: spread out before these are written out, by another expression than
    # the join's, since the same one would be dropped as done already and its small partitions merged.
    shown = (
        spread_out(users.join(tastes, "user_id", "left"), F.xxhash64("user_id"))
        .join(broadcast_up_to(head, HEAD_ROWS), "user_band")
        .withColumn("taste", F.element_at("tastes", F.col("category")))
        .withColumns({"spared": F.coalesce("taste.spared", F.lit(1)), "boost": F.col("taste.boost")})
    )

    heavy = users.join(taste.filter(F.col("bought") > head_size - needed), "user_id")
    stepped = places.withColumn("step", F.floor((F.col("place") - 1) / head_size))
    last = F.floor((F.col("bought") + needed - 1) / head_size)
    first_of_run = F.col("run") * RUN
    steps = heavy.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor(last / RUN)))).withColumn(
        "step", F.explode(F.sequence(F.greatest(first_of_run, F.lit(1)), F.least(first_of_run + RUN - 1, last)))
    )
    # Nearly all heavy buyers need the same few steps, so those go to every executor; the deep ones are shuffled.
    near = broadcast_up_to(stepped.filter(F.col("step") < NEAR_STEPS), HEAD_ROWS)
    by_step = ["user_band", "category", "step"]
    further = (
        steps.filter(F.col("step") < NEAR_STEPS)
        .join(near, by_step)
        .select(*columns)
        .unionByName(
            steps.filter(F.col("step") >= NEAR_STEPS)
            .join(stepped.filter(F.col("step") >= NEAR_STEPS), by_step)
            .select(*columns)
        )
        .filter((F.col("id_place") > head_size) & (F.col("id_place") != F.col("spared")))
    )
    late_spared = (
        heavy.filter(F.col("spared") > head_size)
        .join(
            places.filter(F.col("place") > head_size).withColumn("spared", F.col("id_place")),
            ["user_band", "category", "spared"],
        )
        .select(*columns)
    )
    # Of the pairs only those with a head product can close a head place, which are few.
    mine = bought.select("user_id", "product_id")
    head_products = head.select("product_id").distinct()
    taken_head = mine.join(broadcast_up_to(head_products, HEAD_ROWS), "product_id", "left_semi")
    open_head = shown.select(*columns).join(
        broadcast_up_to(cut(taken_head), HEAD_ROWS), ["user_id", "product_id"], "left_anti"
    )
    open_rest = further.unionByName(late_spared).join(mine, ["user_id", "product_id"], "left_anti")
    open_places = open_head.unionByName(open_rest)
    boost = F.when(F.col("boost").isNotNull(), F.col("boost") + 1).otherwise(1.0)
    spared = (F.col("id_place") == F.col("spared")) | (F.col("category") == "")
    score = F.col("base") * boost * F.when(spared, 1.0).otherwise(REPEAT_PENALTY)
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("base"), "product_id")
    return (
        open_places.withColumn("score", score)
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= n)
        .select("user_id", "position", "product_id", "score")
    )


def per_user_shuffle(products: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` products in each user's own order, by ``user_id % 100``.

    A user's order starts with ``(product * user) % 100``, which depends on the last two digits of both ids only.  So the
    first ``n`` products of each of the 100 product endings are enough to fill the list of each of the 100 user endings.
    """
    ending = Window.partitionBy("ending").orderBy(*order)
    few = (
        products.withColumn("ending", F.pmod("product_id", F.lit(RESIDUES)))
        .withColumn("rank", F.row_number().over(ending))
        .filter(F.col("rank") <= n)
    )
    by_user = Window.partitionBy("residue").orderBy(F.pmod(F.col("ending") * F.col("residue"), F.lit(RESIDUES)), *order)
    return (
        few.withColumn("residue", F.explode(F.sequence(F.lit(0), F.lit(RESIDUES - 1))))
        .withColumn("position", F.row_number().over(by_user))
        .filter(F.col("position") <= n)
        .select("residue", "position", "product_id")
    )


def _approved(t: Tables) -> DataFrame:
    return t.products.filter(F.col("status") == "Approved").select(
        F.col("id").alias("product_id"), "created_at", "popularity_score"
    )


def fallback_list(t: Tables, n: int = SHORT_LIST) -> DataFrame:
    """Approved products, newest first within a user's own order."""
    return per_user_shuffle(_approved(t), [F.desc("created_at"), F.col("product_id")], n)


def popular_list(t: Tables, n: int = SHORT_LIST) -> DataFrame:
    """Approved products by popularity score within a user's own order."""
    order = [F.desc("popularity_score"), F.desc("created_at"), F.col("product_id")]
    return per_user_shuffle(_approved(t), order, n)


def bought_list(t: Tables, n: int = SHORT_LIST) -> DataFrame:
    """Approved products somebody bought, most purchases first within a user's own order."""
    counts = t.purchases.groupBy("product_id").agg(F.count(F.lit(1)).alias("purchases"))
    return per_user_shuffle(_approved(t).join(counts, "product_id"), [F.desc("purchases"), F.col("product_id")], n)


def for_users(users: DataFrame, lists: DataFrame, *keys: str) -> DataFrame:
    """A list per user from the lists per user ending, which hold at most 100 endings times the list length per kind."""
    return users.withColumn("residue", F.pmod("user_id", F.lit(RESIDUES))).join(F.broadcast(lists), ["residue", *keys])


def newest_products(t: Tables, n: int = SHORT_LIST) -> DataFrame:
    """Newest Approved products."""
    return (
        t.products.filter(F.col("status") == "Approved")
        .orderBy(F.desc("created_at"), "id")
        .limit(n)
        .select("id", "name", "category", "price", "created_at")
    )


def recommendations(t: Tables, users: DataFrame, scores: DataFrame) -> DataFrame:
    """Every user's list with the branch it came from.

    ``users`` gives the score band of the users known to the model.  A personal user without a list (no band, or no
    scores in it) gets the last resort: a long list of the newest products.
    """
    kinds = cut(recommendation_type(candidate_counts(t)))
    known = kinds.filter(F.col("type") == "personalized").select("user_id")
    personal = cut(top_recommendations(t, users.join(known, "user_id", "left_semi"), scores).drop("score"))
    listed = personal.filter(F.col("position") == 1).select("user_id", F.lit(True).alias("listed"))
    others = (
        kinds.join(listed, "user_id", "left")
        .filter(F.col("listed").isNull())
        .select("user_id", F.when(F.col("type") == "personalized", LAST_RESORT).otherwise(F.col("type")).alias("type"))
    )
    newest = fallback_list(t, PERSONAL)
    short = newest.filter(F.col("position") <= SHORT_LIST)
    lists = {
        "popularity_fallback_new_user": bought_list(t),
        "popularity_no_history": popular_list(t),
        "general_fallback": short,
        "new_products_fallback": short,
        LAST_RESORT: newest,
    }
    rows = reduce(DataFrame.unionByName, [df.withColumn("type", F.lit(kind)) for kind, df in lists.items()])
    columns = ["user_id", "type", "position", "product_id"]
    return (
        personal.withColumn("type", F.lit("personalized"))
        .select(*columns)
        .unionByName(for_users(others, rows, "type").select(*columns))
    )
