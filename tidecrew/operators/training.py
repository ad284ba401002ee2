"""Training data and rating model of the recommender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecrew.operators import boosted
from tidecrew.operators.boosted import Boosted, Settings
from tidecrew.plans.combine import spread_out
from tidecrew.plans.durable import cut
from tidecrew.plans.running import dense_index, running_totals, spread
from tidecrew.sources.catalog import Tables
from tidecrew.sources.mapping import AS_OF

# Bins, activity limits, split, serving default and serving price bands.
PRICE_BINS = 5
MIN_RATINGS = 3
MIN_ACTIVE_USERS = 5
TEST_PARTS = 5
SEED = 42
SERVING_DAYS = 30
SERVING_BANDS = (100, 500, 1000, 5000)
SERVING_DEFAULT_BAND = 2

# Users enter the model as the range their code falls in, since products are scored once per range rather than per user.
# Default number of ranges; every job below takes another as ``bands``.
USER_BANDS = 32
# Smallest probability of a rating that the log loss takes into account.
LEAST_SHARE = 1e-15
FEATURES = ("user_band", "product_code", "category_code", "price_band", "days_since_purchase")


# Name of a table that holds the training set, where a job has stored it.
STORED_SET = "stored_training_set"


def training_set(t: Tables) -> DataFrame:
    """Rated purchases with product category and price."""
    if t.has(STORED_SET):
        return getattr(t, STORED_SET)
    bought = t.purchases.select(F.col("id").alias("purchase_history_id"), "purchase_date")
    listed = t.products.select(F.col("id").alias("product_id"), "category", "price")
    return (
        t.product_feedback.select("purchase_history_id", "user_id", "product_id", "rating")
        .join(bought, "purchase_history_id")
        .join(listed, "product_id")
        .select(
            F.col("purchase_history_id").alias("purchase_id"),
            "user_id",
            "product_id",
            "rating",
            "category",
            "price",
            "purchase_date",
        )
    )


def whole_days(later: str, earlier: str) -> Column:
    """Whole days between two moments, rounded down."""
    micros = F.unix_micros(F.lit(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(86400000000).cast("decimal(20,0)")).cast("bigint")


def price_edges(rows: DataFrame, bins: int = PRICE_BINS) -> list[int]:
    """The distinct quantile edges of the price below the top one, in units of 1 / (100 * bins).

    Quantiles interpolate linearly between neighbouring prices.  They are read off a histogram of the prices with a
    distributed running count, in whole numbers, so an edge that equals a price does so exactly.  Only the handful of
    edges comes to the driver.
    """
    cents = (F.col("price") * 100).cast("bigint")
    histogram = cut(
        rows.filter(F.col("price").isNotNull()).groupBy(cents.alias("cents")).agg(F.count(F.lit(1)).alias("n"))
    )
    last = (histogram.agg(F.sum("n").alias("n")).first()["n"] or 0) - 1
    if last < 0:
        return []
    counted = running_totals(histogram, [], "cents", {"up_to": F.col("n")})
    positions = sorted({min(p, last) for k in range(bins) for p in (last * k // bins, last * k // bins + 1)})
    found = counted.agg(
        *[F.min(F.when(F.col("up_to") > p, F.col("cents"))).alias(str(p)) for p in positions]
    ).first()
    edges = set()
    for k in range(bins):
        low, rest = divmod(last * k, bins)
        below, above = found[str(low)], found[str(min(low + 1, last))]
        edges.add(below * bins + (above - below) * rest)
    return sorted(edges)


def training_features(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """The training set with age of the purchase in days and price band 0..4.

    Bands are right-closed quantile bins; equal edges are merged.
    """
    rows = training_set(t)
    scaled = (F.col("price") * 100 * PRICE_BINS).cast("bigint")
    below = sum((F.when(scaled > edge, 1).otherwise(0) for edge in price_edges(rows)), F.lit(-1))
    return rows.withColumns(
        {"days_since_purchase": whole_days(as_of, "purchase_date"), "price_band": F.greatest(below, F.lit(0))}
    )


def active_raters(t: Tables, at_least: int = MIN_RATINGS) -> DataFrame:
    """Users with enough ratings."""
    counts = training_set(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("ratings"))
    return counts.filter(F.col("ratings") >= at_least)


def active_rater_check(t: Tables) -> DataFrame:
    """How many users rate enough, and whether that suffices for personal results."""
    return active_raters(t).agg(
        F.count(F.lit(1)).alias("active_users"), (F.count(F.lit(1)) >= MIN_ACTIVE_USERS).alias("enough")
    )


def rating_distribution(t: Tables) -> DataFrame:
    """Ratings in the training set by value."""
    return training_set(t).groupBy("rating").agg(F.count(F.lit(1)).alias("ratings"))


def _small_index(rows: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0; for closed lists such as ratings and product types."""
    values = rows.select(column).distinct()
    return values.withColumn("index", (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))


def rating_index(t: Tables) -> DataFrame:
    """Ratings that occur, numbered from 0."""
    return _small_index(training_set(t), "rating")


def label_encoding(t: Tables) -> DataFrame:
    """Codes of users, products and categories: sorted distinct values numbered from 0."""
    rows = training_set(t)
    users = dense_index(rows, "user_id").select(
        F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("value"), "index"
    )
    products = dense_index(rows, "product_id").select(
        F.lit("product").alias("kind"), F.col("product_id").cast("string").alias("value"), "index"
    )
    categories = _small_index(rows, "category").select(
        F.lit("category").alias("kind"), F.col("category").alias("value"), "index"
    )
    return users.unionByName(products).unionByName(categories)


def is_test(purchase_id: Column, seed: int = SEED) -> Column:
    """A repeatable fifth of the purchases."""
    return spread(purchase_id + seed, F.lit(TEST_PARTS)) == 0


def train_test_split(t: Tables) -> DataFrame:
    """Rated purchases with the side of the split they fall on."""
    return training_set(t).select(
        "purchase_id", "rating", F.when(is_test(F.col("purchase_id")), "test").otherwise("train").alias("side")
    )


def user_bands(t: Tables, bands: int = USER_BANDS) -> DataFrame:
    """Users of the training set with the range their code falls in."""
    coded = dense_index(training_set(t), "user_id")
    total = training_set(t).select("user_id").distinct().agg(F.count(F.lit(1))).scalar()
    return coded.select("user_id", F.floor(F.col("index") * bands / total).alias("user_band"))


def model_frame(t: Tables, bands: int = USER_BANDS) -> DataFrame:
    """One row per rated purchase with the model's features and its label."""
    rows = training_features(t)
    products = dense_index(rows, "product_id", name="product_code")
    categories = _small_index(rows, "category").withColumnRenamed("index", "category_code")
    labels = _small_index(rows, "rating").withColumnRenamed("index", "label")
    return (
        rows.join(user_bands(t, bands), "user_id")
        .join(products, "product_id")
        .join(categories, "category")
        .join(labels, "rating")
        .select("purchase_id", "rating", F.col("label").cast("double").alias("label"), *FEATURES)
    )


def rating_model(frame: DataFrame, settings: Settings = Settings(seed=SEED)) -> Boosted:
    """Boosted trees over the training side of the split that give a probability per rating; the test side ends the growing."""
    classes = frame.agg(F.coalesce(F.max("label") + 1, F.lit(0))).first()[0]
    test = is_test(F.col("purchase_id"), settings.seed)
    return boosted.fitted(frame, "purchase_id", "label", test, FEATURES, int(classes), settings)


def root_gains(frame: DataFrame) -> DataFrame:
    """The gain of the best first cut of every feature for every class, over all rated purchases."""
    classes = frame.agg(F.coalesce(F.max("label") + 1, F.lit(0))).first()[0]
    found = boosted.root_gains(frame, "purchase_id", "label", FEATURES, int(classes))
    rows = frame.sparkSession.createDataFrame(found, "label int, feature string, threshold long, gain double")
    return rows.withColumn("gain", F.round("gain", 4))


def with_side(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows with a ``purchase_id`` and the side of the split they fall on."""
    return rows.withColumn("side", F.when(is_test(F.col("purchase_id"), seed), "test").otherwise("train"))


def rating_losses(judged: DataFrame) -> DataFrame:
    """Rows, multi-class log loss and accuracy per side.

    ``judged`` has ``side``, ``label`` (the index of the rating) and ``shares`` (a probability per index).  Of equal
    probabilities the first one is the guess; a probability of zero counts as ``LEAST_SHARE``.
    """
    of_truth = F.greatest(F.element_at("shares", F.col("label").cast("int") + 1), F.lit(LEAST_SHARE))
    guess = F.array_position("shares", F.array_max("shares")) - 1
    return judged.groupBy("side").agg(
        F.count(F.lit(1)).alias("ratings"),
        F.round(F.avg(-F.ln(of_truth)), 6).alias("mlogloss"),
        F.round(F.avg((guess == F.col("label").cast("bigint")).cast("double")), 6).alias("accuracy"),
    )


def model_losses(model: Boosted, frame: DataFrame, seed: int = SEED) -> DataFrame:
    """:func:`rating_losses` of a model."""
    return rating_losses(with_side(boosted.with_shares(model, spread_out(frame, "purchase_id")), seed))


def prior_losses(t: Tables, seed: int = SEED) -> DataFrame:
    """:func:`rating_losses` of the plainest model: the share of each rating on the training side."""
    sides = with_side(training_set(t).select("purchase_id", "rating"), seed)
    counts = sides.groupBy("rating").agg(F.count_if(F.col("side") == "train").alias("n"))
    # Both sides of this join hold the ratings that occur, a closed list.
    labels = _small_index(sides, "rating").withColumnRenamed("index", "label")
    everything = F.sum("n").alias("total")
    entries = F.array_sort(F.collect_list(F.struct("rating", "n"))).alias("entries")
    shares = counts.agg(everything, entries).select(F.transform("entries", lambda e: e["n"] / F.col("total"))).scalar()
    return rating_losses(sides.join(labels, "rating").withColumn("shares", shares))


def feature_importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """The mean gain of each feature's splits, largest first; a feature without any is left out."""
    gains = sorted(boosted.gains_of(model).items())
    return spark.createDataFrame(gains, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_metadata(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """What the stored model was trained on: ratings by class, users, products and date."""
    rows = training_set(t)
    ratings = F.array_sort(F.collect_set("rating"))
    by_user = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    by_product = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(
        F.array_join(ratings, ",").alias("index_to_rating"), F.size(ratings).alias("num_classes")
    ).select(
        "index_to_rating",
        "num_classes",
        by_user.agg(F.count(F.lit(1))).scalar().alias("num_users"),
        by_product.agg(F.count(F.lit(1))).scalar().alias("num_products"),
        F.lit(as_of).alias("training_date"),
    )


def save_model(model: Boosted, metadata: DataFrame, path: str) -> None:
    """Store a model and its metadata side by side."""
    boosted.save(model, metadata.sparkSession, f"{path}/model")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[Boosted, DataFrame]:
    """A stored model and its metadata."""
    return boosted.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/metadata")


def score_sums(model: Boosted, frame: DataFrame, ratings: Sequence[int]) -> DataFrame:
    """Rated purchases, their expected ratings in millionths added up, and the probabilities in thousandths added up."""
    scored = boosted.with_shares(model, frame)
    whole = F.round(mean_rating(F.col("shares"), ratings) * 1_000_000).cast("long")
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    return scored.agg(
        F.count(F.lit(1)).alias("ratings"), F.sum(whole).alias("expected"), F.sum(F.round(total * 1000).cast("long")).alias("shares")
    )


def serving_features(t: Tables, days: int = SERVING_DAYS) -> DataFrame:
    """Model features of the products that can be recommended: Approved ones that were rated.

    Price bands are fixed here, unlike the quantile bins of the training set.
    """
    rows = training_set(t)
    codes = dense_index(rows, "product_id", name="product_code")
    categories = _small_index(rows, "category").withColumnRenamed("index", "category_code")
    price = F.col("price")
    band = F.when(price.isNull(), SERVING_DEFAULT_BAND)
    for number, limit in enumerate(SERVING_BANDS):
        band = band.when(price < limit, number)
    return (
        t.products.filter(F.col("status") == "Approved")
        .select(F.col("id").alias("product_id"), "category", "price")
        .join(codes, "product_id")
        .join(categories, "category", "left")
        .select(
            "product_id",
            "category",
            "product_code",
            F.coalesce("category_code", F.lit(0)).alias("category_code"),
            band.otherwise(len(SERVING_BANDS)).alias("price_band"),
            F.lit(days).alias("days_since_purchase"),
        )
    )


def mean_rating(shares: Column, ratings: Sequence[int]) -> Column:
    """Mean of the ratings weighted by an array of their probabilities."""
    weighted = F.zip_with(shares, F.array(*[F.lit(float(r)) for r in ratings]), lambda p, r: p * r)
    return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)


def stored_ratings(metadata: DataFrame) -> list[int]:
    """The ratings by model index that the stored metadata names."""
    return [int(rating) for rating in metadata.first()["index_to_rating"].split(",")]


def product_shares(t: Tables) -> DataFrame:
    """Every rated product with the mean under its own shares of the ratings one to five."""
    values = range(1, 6)
    counts = training_set(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rating") == r).alias(str(r)) for r in values]
    )
    shares = F.array(*[F.col(str(r)) / F.col("n") for r in values])
    return counts.select("product_id", F.round(mean_rating(shares, values), 6).alias("expected"))


def model_scores(t: Tables, model: Boosted, ratings: Sequence[int], bands: int = USER_BANDS) -> DataFrame:
    """Expected rating of every recommendable product for every user band.

    The model sees a user only through the band, so this scores all pairs of user and product there are, in
    ``bands`` rows per product.
    """
    every_band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("user_band")
    # By another expression than the join's: the same one would be dropped as done already, and its small partitions merged.
    rows = spread_out(serving_features(t), F.xxhash64("product_id")).select("*", every_band)
    return boosted.with_shares(model, rows).select(
        F.col("user_band").cast("bigint").alias("user_band"),
        "product_id",
        "category",
        mean_rating(F.col("shares"), ratings).alias("base"),
    )


def mean_scores(t: Tables) -> DataFrame:
    """Smoothed mean rating of every recommendable product: five neutral ratings are added to its own."""
    ratings = training_set(t).groupBy("product_id").agg(F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n"))
    return (
        t.products.filter(F.col("status") == "Approved")
        .select(F.col("id").alias("product_id"), "category")
        .join(ratings, "product_id")
        .select(
            F.lit(0).cast("bigint").alias("user_band"),
            "product_id",
            "category",
            ((F.col("total") + 15) / (F.col("n") + 5)).alias("base"),
        )
    )
