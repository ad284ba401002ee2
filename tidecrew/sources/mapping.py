"""The domain datasets derived from the generic benchmark tables (FIXTURES.md section 2).

Only integer arithmetic and exact decimals are used, so any engine derives the same rows.  Row counts of the base
tables enter as scalar subqueries: nothing is counted on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.sources.catalog import Tables

AS_OF = "2001-07-15 00:00:00"
CUSTOMER_BASE = 1000000

# Given outright: asking the files for their schema is a job of its own for every table and query.
BENCHMARK_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def benchmark_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All domain datasets over the benchmark parquet files in ``sf_dir``."""

    opened: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.schema(BENCHMARK_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def rows(name: str) -> Column:
        return raw(name).agg(F.count(F.lit(1))).scalar()

    def users() -> DataFrame:
        nation = raw("nation").select("n_nationkey", "n_name")
        organisers = (
            raw("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("id"),
                F.col("s_name").alias("username"),
                F.col("n_name").alias("location"),
                F.lit("organiser").alias("role"),
                F.expr("cast(s_suppkey % 365 as int)").alias("age"),
            )
        )
        members = (
            raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                (F.col("c_custkey") + CUSTOMER_BASE).alias("id"),
                F.col("c_name").alias("username"),
                F.expr(
                    "case when c_custkey % 7 = 0 then null "
                    "when c_custkey % 3 = 0 then concat(8 + c_custkey % 5, '.5,', 76 + c_custkey % 4, '.25') "
                    "else n_name end"
                ).alias("location"),
                F.expr(
                    "case when c_custkey % 10 < 5 then 'volunteer' when c_custkey % 10 < 9 then 'buyer' else 'other' end"
                ).alias("role"),
                F.expr("cast(c_custkey % 730 as int)").alias("age"),
            )
        )
        return organisers.unionByName(members).select(
            "id",
            "username",
            F.expr("concat(lower(replace(username, '#', '_')), '@example.org')").alias("email"),
            F.col("id").cast("string").alias("mobile"),
            "location",
            "role",
            F.expr("cast(date_sub(date'2001-07-15', age) as timestamp_ntz)").alias("created_at"),
        )

    def drives() -> DataFrame:
        key = raw("orders").select(
            F.col("o_orderkey").alias("id"),
            "o_orderstatus",
            "o_orderdate",
            ((F.col("o_custkey") * 7) % rows("supplier")).alias("v"),
        )
        return key.selectExpr(
            "id",
            "case when id % 97 = 0 then null when v % 10 = 9 then v - 1 else v end as organiser_id",
            "concat('drive ', id % 500) as event_name",
            "cast(o_orderdate as date) as event_date",
            "concat(lpad(cast(6 + id % 12 as string), 2, '0'), ':00:00') as event_time",
            "1 + id % 8 as num_volunteers",
            "cast(100 + (id % 50) * 10 as decimal(10,2)) as salary_per_volunteer",
            "cast(8.5 + id % 6 as double) as latitude",
            "cast(76.25 + id % 4 as double) as longitude",
            "case id % 4 when 0 then null when 1 then concat('/static/uploads/drive_', id, '.jpg') "
            "when 2 then concat(' static/drive_', id, '.png ') else concat('drive_', id, '.gif') end as photo_path",
            "case when id % 13 = 0 then null when id % 3 = 0 then 'gloves' when id % 3 = 1 then 'gloves,bags' "
            "else 'gloves,bags,water' end as supplies",
            "case when id % 53 = 0 then null when o_orderstatus = 'F' then 'Completed' "
            "when o_orderstatus = 'P' then 'Active' when o_orderstatus = 'O' then 'Upcoming' end as status",
            "case when id % 31 = 0 then null else id % 40 end as products_recycled",
            "cast(date_sub(cast(o_orderdate as date), 14) as timestamp_ntz) as created_at",
            "cast(null as double) as plastics_collected",
        )

    def drive_volunteers() -> DataFrame:
        volunteer = (
            (F.col("l_partkey") % F.floor(rows("customer") / F.lit(10.0)).cast("bigint")) * 10
            + F.col("l_suppkey") % 5
            + CUSTOMER_BASE
        )
        return (
            raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("event_id"), volunteer.alias("volunteer_id"))
            .agg(
                F.max("l_linenumber").cast("bigint").alias("hours_worked"),
                F.max("l_quantity").alias("top_quantity"),
                F.max("l_returnflag").alias("flag"),
                F.min("l_shipdate").alias("joined_date"),
            )
            .selectExpr(
                "event_id",
                "volunteer_id",
                "joined_date",
                "case when hours_worked = 7 then null else top_quantity / 2.0D end as plastics_collected",
                "hours_worked",
                "case flag when 'R' then 'Paid' when 'N' then 'Pending' end as payment_status",
            )
        )

    def products() -> DataFrame:
        return (
            raw("part")
            .withColumn("organiser_id", F.col("p_partkey") % rows("supplier"))
            .withColumn(
                "price", F.expr("cast(((p_partkey * 7919) % 700000 + 500) / 100.0 as decimal(10,2))")
            )
            .selectExpr(
                "p_partkey as id",
                "p_name as name",
                "case when p_partkey % 23 = 0 then null else concat(p_type, ' ', p_brand) end as description",
                "price",
                "case when p_partkey % 6 = 0 then cast(price * 0.9 as decimal(10,2)) end as discounted_price",
                "case when p_size % 3 = 0 then 'wholesale' else 'recycled' end as category",
                "case when p_size % 3 = 0 then 'kg' else 'units' end as units",
                "case when p_partkey % 29 = 0 then null when p_partkey % 11 = 0 then 0 "
                "else cast(p_size as bigint) end as quantity",
                "case when p_partkey % 10 = 0 then 'Pending' when p_partkey % 10 = 1 then 'Rejected' "
                "when p_partkey % 20 = 2 then 'Deleted' else 'Approved' end as status",
                "organiser_id",
                "case when p_partkey % 5 = 0 then null else concat('product_', p_partkey, '.png') end as image_path",
                "date_add(date'2000-01-01', cast(p_partkey % 400 as int)) as created_at",
                "p_partkey % 17 as popularity_score",
            )
        )

    def purchases() -> DataFrame:
        # Aggregating first keeps a hot order small before it meets the joins.
        lines = (
            raw("lineitem")
            .groupBy("l_orderkey", "l_partkey")
            .agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
        )
        orders = raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        sold = tables.products.selectExpr("id as product_id", "name as product_name", "price", "discounted_price")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(sold, F.col("l_partkey") == F.col("product_id"))
            .selectExpr(
                "l_orderkey * 1000000 + l_partkey as id",
                f"{CUSTOMER_BASE} + o_custkey as user_id",
                "product_id",
                "product_name",
                "price",
                "discounted_price",
                "quantity",
                "cast(price * quantity as decimal(14,2)) as total_amount",
                "o_orderdate as purchase_date",
                "case when o_orderstatus = 'O' then 'Pending' else 'Completed' end as status",
            )
        )

    def product_feedback() -> DataFrame:
        return (
            tables.purchases.filter("id % 3 = 0")
            .selectExpr(
                "id * 10 as id",
                "id as purchase_history_id",
                "user_id",
                "product_id",
                "cast(1 + (id * 3) % 5 as int) as rating",
                "concat('comment ', id) as comment",
                "purchase_date + interval 2 days as created_at",
            )
        )

    def donations() -> DataFrame:
        given = raw("events").filter("event_type = 'purchase'")
        return given.withColumn("slot", F.col("event_id") % rows("supplier")).selectExpr(
            "event_id as id",
            "concat('donor_', user_id) as donor_name",
            "concat('donor_', user_id, '@example.org') as donor_email",
            "cast(user_id as string) as donor_phone",
            "cast(value as decimal(10,2)) as amount",
            "case when event_id % 17 = 0 then null else slot end as organiser_id",
            "ts - interval 8235 days as donation_date",
            "case when event_id % 4 = 0 then 'Completed' else 'Pending' end as status",
        )

    def completed_participation() -> DataFrame:
        done = tables.drives.filter("status = 'Completed'").select(F.col("id").alias("event_id"))
        return tables.drive_volunteers.join(done, "event_id", "left_semi")

    def volunteer_badges() -> DataFrame:
        return (
            completed_participation()
            .filter("plastics_collected >= 18")
            .selectExpr(
                "event_id * 10000000 + volunteer_id as id",
                "volunteer_id",
                "event_id",
                "case when plastics_collected < 20 then 'bronze' when plastics_collected < 22 then 'gold' "
                "when plastics_collected < 24 then 'platinum' else 'Diamond' end as badge_type",
                "joined_date as awarded_date",
            )
        )

    def drive_feedback() -> DataFrame:
        return (
            completed_participation()
            .filter("(event_id + volunteer_id) % 4 = 0")
            .selectExpr(
                "event_id",
                "volunteer_id",
                "cast(1 + (event_id + volunteer_id) % 5 as int) as rating",
                "concat('feedback ', event_id, '-', volunteer_id) as feedback_text",
                "joined_date + interval 3 days as submission_date",
            )
        )

    def cart() -> DataFrame:
        lines = (
            raw("events")
            .filter("event_type = 'click'")
            .groupBy(
                (F.col("user_id") % rows("customer") + CUSTOMER_BASE).alias("user_id"),
                (F.col("event_id") % rows("part")).alias("product_id"),
            )
            .agg(F.count(F.lit(1)).alias("quantity"))
        )
        listed = tables.products.selectExpr("id as product_id", "name as product_name", "price", "discounted_price")
        return lines.join(listed, "product_id").select(
            "user_id", "product_id", "product_name", "quantity", "price", "discounted_price"
        )

    def system_settings() -> DataFrame:
        return spark.createDataFrame(
            [("site_name", "Clean Coast"), ("contact_email", "crew@example.org"), ("maintenance_mode", "off")],
            "setting_key string, setting_value string",
        )

    def places() -> DataFrame:
        # Offline place names by coordinate; the first nation of a coordinate names it.
        return (
            raw("nation")
            .selectExpr(
                "cast(8.5 + n_nationkey % 5 as double) as latitude",
                "cast(76.25 + n_nationkey % 4 as double) as longitude",
                "cast(n_nationkey as bigint) as n_nationkey",
            )
            .groupBy("latitude", "longitude")
            .agg(F.min("n_nationkey").alias("n"))
            .select("latitude", "longitude", F.concat(F.lit("Beach "), F.col("n").cast("string")).alias("display_name"))
        )

    def geocoder_responses() -> DataFrame:
        # Stored answers of a geocoding service, one per customer address; parts are missing here and there.
        return raw("customer").selectExpr(
            "c_custkey as id",
            """case when c_custkey % 9 = 0 then '{"error": "Unable to geocode"}' else concat('{"address": {',
            concat_ws(', ',
              case when c_custkey % 2 = 0 then concat('"road": "Road ', c_custkey, '"') end,
              case when c_custkey % 3 = 0 then concat('"suburb": "Suburb ', c_custkey % 50, '"') end,
              case when c_custkey % 4 = 0 then concat('"city": "City ', c_nationkey, '"') end,
              case when c_custkey % 4 < 2 then concat('"town": "Town ', c_nationkey, '"') end,
              case when c_custkey % 5 > 0 then concat('"state": "State ', c_custkey % 7, '"') end,
              case when c_custkey % 6 > 1 then concat('"postcode": "', 600000 + c_custkey % 1000, '"') end),
            '}}') end as response""",
        )

    builders = {
        builder.__name__: builder
        for builder in (
            users, drives, drive_volunteers, drive_feedback, volunteer_badges, donations, products, purchases,
            product_feedback, cart, system_settings, places, geocoder_responses,
        )
    }
    for name in ("events", "customer", "part", "supplier", "orders"):
        builders[f"raw_{name}"] = lambda name=name: raw(name)
    tables = Tables(spark, builders)
    return tables
