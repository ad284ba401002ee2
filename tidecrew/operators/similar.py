"""Collaborative filtering for one user or a cohort: who buys alike, and what they bought.

The work for one user is linear in the purchases, that for a cohort in the cohort's purchases times the buyers of what
it bought.  For all users at once see :mod:`tidecrew.operators.closest`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.operators.recommend import SHORT_LIST
from tidecrew.plans.blockwise import blocks_for, met, packed
from tidecrew.plans.combine import spread_out
from tidecrew.plans.durable import cut, kept, shared_dir
from tidecrew.plans.running import dense_index
from tidecrew.sources.catalog import Tables

# Fixed value: neighbours looked at, the user included.
NEIGHBOURS = 5

# Pairs of user and product in a block of the learner, which holds its block in memory, and its least number of blocks.
LEARNT = 1 << 23
LEARNER_BLOCKS = 10
# Factors in a block, at most and while cores are idle; users of a block looked at together, and products per step.  A task holds
# a block of each side several times over: packed, unpacked, and on its way between the processes.
VECTORS = 1 << 18
LEAST_VECTORS = 1 << 10
TOGETHER = 1024
FIRST_STEP, STEP = 64, 2048
# Part of a product of lengths by which a score in single precision can be wrong, several times over.
ROUNDING = 1e-5


def busiest_buyer(t: Tables) -> Column:
    """The user with most purchases, as a scalar."""
    counts = t.purchases.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "user_id").limit(1).select("user_id").scalar()


def similar_users(t: Tables, user: int | Column, k: int = NEIGHBOURS) -> DataFrame:
    """The users whose purchase counts have the largest cosine with the user's, the user first.

    ``closeness`` is the squared cosine up to the user's own constant: exact, and in the same order.
    """
    target = F.lit(user) if isinstance(user, int) else user
    counts = t.purchases.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.filter(F.col("user_id") == target).select("product_id", F.col("n").alias("own"))
    per_user = (
        counts.join(wanted, "product_id", "left")
        .groupBy("user_id")
        .agg(
            F.sum(F.col("n") * F.coalesce("own", F.lit(0))).alias("dot"),
            F.sum(F.col("n") * F.col("n")).alias("norm"),
        )
    )
    closeness = F.col("dot").cast("double") * F.col("dot") / F.col("norm")
    return (
        per_user.withColumn("closeness", closeness)
        .orderBy(F.col("user_id") != target, F.desc("closeness"), "user_id")
        .limit(k)
        .select("user_id", "dot", "norm", "closeness")
    )


def cf_recommendations(t: Tables, user: int | Column, n: int = SHORT_LIST) -> DataFrame:
    """Products similar users bought most; else popular products; else the newest ones."""
    target = F.lit(user) if isinstance(user, int) else user
    own = t.purchases.filter(F.col("user_id") == target).select("product_id").distinct()
    # A user without purchases has no neighbours.
    others = similar_users(t, user).filter(F.col("user_id") != target).select("user_id")
    neighbours = others.filter(own.agg(F.count(F.lit(1)) > 0).scalar())
    weights = (
        t.purchases.select("user_id", "product_id")
        .join(neighbours, "user_id", "left_semi")
        .join(own, "product_id", "left_anti")
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy(F.desc("weight"), "product_id")
        .limit(n)
    )
    approved = t.products.filter(F.col("status") == "Approved").select(F.col("id").alias("product_id"), "created_at")
    popular = (
        t.purchases.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy(F.desc("weight"), "product_id")
        .limit(n)
        .join(own, "product_id", "left_anti")
        .filter(weights.agg(F.count(F.lit(1)) == 0).scalar())
    )
    newest = approved.orderBy(F.desc("created_at"), "product_id").limit(n).withColumn("weight", F.lit(0).cast("bigint"))

    def offer(df: DataFrame, kind: str, order: int) -> DataFrame:
        return df.select("product_id", "weight", F.lit(kind).alias("type"), F.lit(order).alias("choice"))

    offers = (
        offer(weights.join(approved, "product_id"), "personalized", 0)
        .unionByName(offer(popular.join(approved, "product_id"), "popular", 1))
        .unionByName(offer(newest, "newest", 2))
    )
    return offers.filter(F.col("choice") == offers.agg(F.min("choice")).scalar()).select("type", "product_id", "weight")


def similar_users_of(t: Tables, cohort: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """:func:`similar_users` for every user of ``cohort`` (user_id); users without purchases have no rows.

    Buyers without a common product only fill a list up, in order of their ids, so the ``k`` lowest ids are enough of
    them.
    """
    counts = t.purchases.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("user_id").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    asked = cohort.select(F.col("user_id").alias("target")).distinct()
    wanted = counts.join(asked, F.col("user_id") == F.col("target"), "left_semi").select(
        F.col("user_id").alias("target"), "product_id", F.col("n").alias("own")
    )
    # The fact side stays on the left: a product that very many buy is split there at run time.
    common = counts.join(wanted, "product_id").select("target", "user_id", (F.col("n") * F.col("own")).alias("dot"))
    lowest = norms.orderBy("user_id").limit(k).agg(F.collect_list("user_id")).scalar()
    filled = (
        wanted.select("target")
        .distinct()
        .withColumn("user_id", F.explode(lowest))
        .withColumn("dot", F.lit(0).cast("bigint"))
    )
    closeness = F.col("dot").cast("double") * F.col("dot") / F.col("norm")
    nearest = Window.partitionBy("target").orderBy(F.col("user_id") != F.col("target"), F.desc("closeness"), "user_id")
    return (
        common.unionByName(filled)
        .groupBy("target", "user_id")
        .agg(F.sum("dot").alias("dot"))
        .join(norms, "user_id")
        .withColumn("closeness", closeness)
        .withColumn("position", F.row_number().over(nearest))
        .filter(F.col("position") <= k)
        .select("target", "position", "user_id", "dot", "norm", "closeness")
    )


def cf_recommendations_of(t: Tables, cohort: DataFrame, n: int = SHORT_LIST, alike: DataFrame | None = None) -> DataFrame:
    """:func:`cf_recommendations` for every user of ``cohort`` (user_id).

    ``alike`` (target, user_id) are their similar users, if these are known already.
    """
    asked = cut(cohort.select(F.col("user_id").alias("target")).distinct())
    own = cut(
        t.purchases.join(asked, F.col("user_id") == F.col("target"), "left_semi")
        .select(F.col("user_id").alias("target"), "product_id")
        .distinct()
    )
    alike = similar_users_of(t, cohort) if alike is None else alike.join(asked, "target", "left_semi")
    alike = alike.filter(F.col("user_id") != F.col("target")).select("target", "user_id")
    approved = t.products.filter(F.col("status") == "Approved").select(F.col("id").alias("product_id"), "created_at")
    best = Window.partitionBy("target").orderBy(F.desc("weight"), "product_id")
    # What similar users bought and what the user has meet in one shuffle by user, which counting and ranking need no more after.
    counts = t.purchases.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("weight"))
    rows = (
        counts.join(alike, "user_id")
        .select("target", "product_id", "weight", F.lit(False).alias("has"))
        .unionByName(
            own.filter(F.col("product_id").isNotNull()).select(
                "target", "product_id", F.lit(0).cast("bigint").alias("weight"), F.lit(True).alias("has")
            )
        )
    )
    personal = (
        spread_out(rows, "target")
        .groupBy("target", "product_id")
        .agg(F.sum("weight").alias("weight"), F.max("has").alias("has"))
        .filter(~F.col("has"))
        .withColumn("nth", F.row_number().over(best))
        .filter(F.col("nth") <= n)
        .select("target", "product_id", "weight")
    )
    personal = cut(personal)
    popular = (
        t.purchases.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy(F.desc("weight"), "product_id")
        .limit(n)
    )
    newest = approved.orderBy(F.desc("created_at"), "product_id").limit(n).withColumn("weight", F.lit(0).cast("bigint"))

    def everybody(people: DataFrame, top: DataFrame) -> DataFrame:
        """``n`` products at most for each of ``people``."""
        entries = top.agg(F.collect_list(F.struct("product_id", "weight"))).scalar()
        return people.withColumn("entry", F.explode(entries)).select("target", "entry.product_id", "entry.weight")

    # Who has a personal list keeps it, whatever of it is approved; the popular products are for the rest.
    rest = asked.join(personal.select("target").distinct(), "target", "left_anti")
    offers = cut(
        personal.withColumn("type", F.lit("personalized"))
        .unionByName(
            everybody(rest, popular).join(own, ["target", "product_id"], "left_anti").withColumn("type", F.lit("popular"))
        )
        .join(approved.select("product_id"), "product_id", "left_semi")
        .select("target", "type", "product_id", "weight")
    )
    empty = asked.join(offers.select("target").distinct(), "target", "left_anti")
    return offers.unionByName(
        everybody(empty, newest).select("target", F.lit("newest").alias("type"), "product_id", "weight")
    )


def factor_model(t: Tables, rank: int = 16, rounds: int = 10, seed: int = 42) -> ALSModel:
    """Factors of users and products whose products approximate how often a user bought a product, by alternating least squares."""
    return _fitted(t, *_numbers(t), rank, rounds, seed)


def _numbers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Numbers of the users and of the products that were bought, since the learner takes ids of 32 bits."""
    bought = t.purchases.select("user_id", "product_id")
    return dense_index(bought, "user_id", name="user"), dense_index(bought, "product_id", name="product")


def _fitted(t: Tables, users: DataFrame, products: DataFrame, rank: int, rounds: int, seed: int = 42) -> ALSModel:
    counts = t.purchases.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    coded = counts.join(users, "user_id").join(products, "product_id").select(F.col("user").cast("int"), F.col("product").cast("int"), "n")
    shared_dir(t.spark)
    ratings = kept(coded, "ratings")
    blocks = max(LEARNER_BLOCKS, -(-ratings.count() // LEARNT))
    # What a round shuffles stays until the next checkpoint, and is far more than the factors that one writes.
    learner = ALS(
        userCol="user", itemCol="product", ratingCol="n", rank=rank, maxIter=rounds, regParam=0.05, implicitPrefs=True,
        alpha=10.0, seed=seed, checkpointInterval=1, numUserBlocks=blocks, numItemBlocks=blocks,
    )
    return learner.fit(ratings)


class Factors(NamedTuple):
    """Numbers with their factors, longest vector first and of equal ones the highest number."""

    number: np.ndarray
    vector: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Factors:
        rows = rows.combine_chunks()
        number = rows.column("id").to_numpy().astype(np.int64)
        vector = rows.column("features").combine_chunks().flatten().to_numpy().reshape(len(number), -1)
        length = np.linalg.norm(vector.astype(np.float64), axis=1)
        order = np.lexsort((-number, -length))
        return Factors(number[order], np.ascontiguousarray(vector[order]), length[order])


def best_offers(users: Factors, products: Factors, n: int) -> pa.Table:
    """(user, product, score) of the ``n`` products of largest inner product with every user.

    Products come longest first.  No inner product exceeds the product of the two lengths, so a user is through when the length of
    the next product cannot make up for the least score of a full list.
    """
    out = []
    for first in range(0, len(users.number), TOGETHER):
        own = slice(first, first + TOGETHER)
        vector, length = users.vector[own], users.length[own]
        score = np.full((len(length), n), -np.inf, dtype=np.float32)
        place = np.full((len(length), n), -1, dtype=np.int64)
        live, at, step = np.arange(len(length)), 0, FIRST_STEP
        while at < len(products.number):
            # A little more than the bound, for the rounding of the scores.
            live = live[length[live] * products.length[at] * (1 + ROUNDING) > score[live, -1]]
            if not len(live):
                break
            scores = vector[live] @ products.vector[at : at + step].T
            row, column = np.nonzero(scores > score[live, -1:])
            changed, row = np.unique(row, return_inverse=True)
            if len(changed):
                held = live[changed]
                # Those already listed stand first among equal scores.
                rows = np.concatenate([np.repeat(np.arange(len(held)), n), row])
                found = np.concatenate([score[held].ravel(), scores[changed[row], column]])
                spot = np.concatenate([place[held].ravel(), at + column])
                order = np.lexsort((-found, rows))
                begin = np.searchsorted(rows[order], np.arange(len(held)))
                top = order[begin[:, None] + np.arange(n)]
                score[held], place[held] = found[top], spot[top]
            at, step = at + step, STEP
        user, nth = np.nonzero(place >= 0)
        place = place[user, nth]
        # Added up factor by factor: the model's own scores to the last digit, and the same for equal vectors wherever they stand.
        total = np.zeros(len(user), dtype=np.float32)
        for one, other in zip(vector[user].T, products.vector[place].T, strict=True):
            total += one * other
        out.append((users.number[own][user], products.number[place], total))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table(dict(zip(("user", "product", "score"), columns, strict=True)))


def factor_recommendations(t: Tables, n: int = SHORT_LIST, rank: int = 16, rounds: int = 10) -> DataFrame:
    """(user_id, position, product_id, score): for every buyer the ``n`` products of highest score, bought ones among them.

    The alternative to similar users.  Blocks of user factors meet blocks of product factors, and a block keeps the best few of
    every user; of equal scores the product with the higher id comes first.
    """
    users, products = (cut(numbers) for numbers in _numbers(t))
    model = _fitted(t, users, products, rank, rounds)
    sides, cores = (model.userFactors, model.itemFactors), t.spark.sparkContext.defaultParallelism
    asking, offered = (side.count() for side in sides)
    shards = blocks_for(offered, VECTORS, VECTORS, cores)
    blocks = blocks_for(asking, VECTORS, LEAST_VECTORS, -(-cores // shards))
    found = met(
        packed(sides[0], "id", blocks, Factors.of),
        packed(sides[1], "id", shards, Factors.of),
        lambda own, others: best_offers(own, others, n),
        "user long, product long, score float",
    )
    best = Window.partitionBy("user").orderBy(F.desc("score"), F.desc("product"))
    rows = (
        found.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= n)
        .select("user", "position", "product", F.col("score").cast("double").alias("score"))
    )
    return rows.join(users, "user").join(products, "product").select("user_id", "position", "product_id", "score")
