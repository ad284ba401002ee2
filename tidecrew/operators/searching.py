"""Search for a whole table of terms at once.

The texts of a product are broken up into runs of one to three letters, and a term looks only at the products that have its rarest
run.  Only runs that some term asks for are listed.  Which of those products match is then decided as for a single
term.  A term of signs alone, or of nothing, has no run and is met with all products, which it finds, or nearly so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.operators.marketplace import (
    CATEGORY_WEIGHT,
    DESCRIPTION_WEIGHT,
    IN_STOCK_POINTS,
    MOST_PURCHASE_POINTS,
    NAME_WEIGHT,
    NEAR_AVERAGE_POINTS,
    SEARCH_TOP,
    product_search,
)
from tidecrew.plans.durable import kept
from tidecrew.sources.catalog import Tables

RUN = 3
SEARCHED = ("name", "description", "category")


def _runs(text: Column, n: int) -> Column:
    """All runs of ``n`` letters of a text."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


def product_runs(products: DataFrame) -> Column:
    """The different runs of one to three letters of a product, and the empty one."""
    lists = [F.coalesce(_runs(F.lower(c), n), F.array().cast("array<string>")) for c in SEARCHED for n in range(1, RUN + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *lists))


def term_runs(term: Column) -> Column:
    """The runs that every text matching a term has: those of its pieces between the signs % and _."""
    pieces = F.filter(F.split(term, "[%_]+"), lambda p: p != "")
    runs = F.transform(pieces, lambda p: F.when(F.length(p) < RUN, F.array(p)).otherwise(_runs(p, RUN)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(runs)))


def wanted_terms(terms: DataFrame) -> DataFrame:
    """(term): the different terms, without white space around them and in lower case; no text is the empty one."""
    bare = F.regexp_replace(F.coalesce("term", F.lit("")), r"^\s+|\s+$", "")
    return terms.select(F.lower(bare).alias("term")).distinct()


def term_matches(t: Tables, terms: DataFrame) -> DataFrame:
    """(term, and the columns of :func:`marketplace.product_search`) for every term of ``terms`` (term) and product it finds."""
    asked = kept(wanted_terms(terms), "terms")
    products = kept(product_search(t, ordered=False), "products")
    runs = asked.select("term", F.explode(term_runs(F.col("term"))).alias("run"))
    listed = products.select("id", F.explode(product_runs(products)).alias("run"))
    postings = kept(listed.join(runs.select("run").distinct(), "run", "left_semi"), "postings")
    sizes = postings.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = runs.join(sizes, "run", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least"))
    chosen = rarest.filter("least.n > 0").select("term", F.col("least.run").alias("run"))
    candidates = postings.join(chosen, "run").select("term", "id")
    # A backslash stands for itself.
    pattern = F.concat(F.lit("%"), F.replace(F.col("term"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    found = candidates.join(products, "id").withColumn("_pattern", pattern)
    matches = F.col("term") == ""
    for c in SEARCHED:
        matches = matches | F.expr(f"lower({c}) like _pattern")
    return found.filter(matches).select("term", *products.columns)


def term_recommendations(t: Tables, terms: DataFrame, n: int = SEARCH_TOP) -> DataFrame:
    """The best scored products of every term, as :func:`marketplace.search_recommendations` scores those of one."""
    rows = kept(term_matches(t, terms), "matches")
    means = rows.filter(F.col("price").isNotNull()).groupBy("term").agg(
        F.sum("price").cast("decimal(25,2)").alias("_total"), F.count(F.lit(1)).cast("decimal(12,0)").alias("_count")
    )
    price = F.coalesce("price", F.lit(0)).cast("decimal(12,2)")
    total, count = (F.coalesce(c, F.lit(0)) for c in ("_total", "_count"))
    near_average = F.abs(price * count - total) * 5 <= total
    named = F.col("term") != ""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    score = (
        F.least(F.col("purchase_count"), F.lit(MOST_PURCHASE_POINTS))
        + points(near_average, NEAR_AVERAGE_POINTS)
        + points(F.col("quantity") > 0, IN_STOCK_POINTS)
    )
    for c, weight in zip(SEARCHED, (NAME_WEIGHT, DESCRIPTION_WEIGHT, CATEGORY_WEIGHT), strict=True):
        score = score + points(named & F.contains(F.lower(c), F.col("term")), weight)
    best = Window.partitionBy("term").orderBy(F.desc("score"), F.desc("id"))
    return (
        rows.join(means, "term", "left")
        .filter(~named | F.col("description").isNotNull())
        .withColumn("score", score.cast("long"))
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= n)
        .select("term", "position", "id", "name", "price", "purchase_count", "score")
    )
