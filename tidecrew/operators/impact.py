"""Impact figures and admin lists over all users, drives, donations and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.functions import stock, text
from tidecrew.plans.combine import all_of, one_row, sorted_if
from tidecrew.sources.catalog import Tables
from tidecrew.sources.mapping import AS_OF

# List lengths and the look-back of the dashboards.
TOP = 10
MONTHS = 12
FEATURED = 8
RECENT_DAYS = 30

DRIVE_COLUMNS = (
    "id",
    "organiser_id",
    "event_name",
    "event_date",
    "event_time",
    "num_volunteers",
    "salary_per_volunteer",
    "latitude",
    "longitude",
    "photo_path",
    "supplies",
    "status",
    "products_recycled",
)


def zero(column: Column) -> Column:
    """NULL as 0."""
    return F.coalesce(column, F.lit(0))


def completed(t: Tables) -> DataFrame:
    return t.drives.filter(F.col("status") == "Completed")


def plastics_per_drive(t: Tables) -> DataFrame:
    """Collected plastics and head count, one row per drive.

    Partial sums run before the shuffle and the rows come out partitioned by drive, so the join back to the drives
    moves nothing of the participation table twice.
    """
    return t.drive_volunteers.groupBy("event_id").agg(
        F.sum("plastics_collected").alias("plastics_collected"), F.count(F.lit(1)).alias("volunteer_count")
    )


def impact_stats(t: Tables) -> DataFrame:
    """Headline totals of the Completed drives."""
    done = completed(t)
    per_volunteer = (
        t.drive_volunteers.join(done, F.col("event_id") == F.col("id"), "left_semi")
        .groupBy("volunteer_id")
        .agg(F.sum("plastics_collected").alias("plastics"))
    )
    return one_row(
        done.agg(F.count("id").alias("total_events"), zero(F.sum("products_recycled")).alias("total_products")),
        per_volunteer.agg(
            F.count("volunteer_id").alias("total_volunteers"), zero(F.sum("plastics")).alias("total_plastics")
        ),
    )


def top_volunteers(t: Tables, n: int = TOP) -> DataFrame:
    """Volunteers with most plastics over Completed drives."""
    per_volunteer = (
        t.drive_volunteers.join(completed(t), F.col("event_id") == F.col("id"), "left_semi")
        .groupBy("volunteer_id")
        .agg(
            zero(F.sum("plastics_collected")).alias("plastics_collected"),
            F.count("event_id").alias("events_participated"),
        )
    )
    return (
        per_volunteer.join(t.users, F.col("volunteer_id") == F.col("id"))
        .orderBy(F.desc("plastics_collected"), "id")
        .limit(n)
        .select(
            F.col("username").alias("name"),
            F.when(text.is_blank("location"), "Location unavailable").otherwise(F.col("location")).alias("location"),
            "plastics_collected",
            "events_participated",
        )
    )


def shuffled_rank(key: Column, seed: int) -> Column:
    """A repeatable pseudo-random order of integer keys."""
    return (key % 1000003) * (2654435761 + 2 * seed) % 1000003


def featured_products(t: Tables, n: int = FEATURED, seed: int = 0) -> DataFrame:
    """A random handful of Approved products with display fields."""
    organisers = t.users.select(F.col("id").alias("organiser_id"), F.col("username").alias("organiser_name"))
    return (
        t.products.filter(F.col("status") == "Approved")
        .join(organisers, "organiser_id")
        .orderBy(shuffled_rank(F.col("id"), seed), "id")
        .limit(n)
        .select(
            "id",
            "name",
            "category",
            "price",
            "quantity",
            "organiser_name",
            stock.format_price(F.col("price")).alias("formatted_price"),
            stock.stock_status(F.col("quantity")).alias("stock_status"),
            stock.stock_text(F.col("quantity")).alias("stock_text"),
            text.image_url(F.col("image_path")).alias("image_url"),
        )
    )


def dashboard_stats(t: Tables) -> DataFrame:
    """Admin totals; plastics count over drives of every status here."""
    return one_row(
        t.users.agg(
            F.count_if(F.col("role") == "organiser").alias("organiser_count"),
            F.count_if(F.col("role") == "volunteer").alias("volunteer_count"),
        ),
        t.drives.agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("status") == "Completed").alias("completed_events"),
        ),
        t.drive_volunteers.agg(zero(F.sum("plastics_collected")).alias("total_plastics_collected")),
        t.donations.agg(zero(F.sum("amount")).alias("total_donations")),
    )


def recent_activities(t: Tables, as_of: str = AS_OF, days: int = RECENT_DAYS, n: int = TOP) -> DataFrame:
    """Newest sign-ups, drives and donations since ``days`` before ``as_of``; future drives pass."""
    since = F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")

    def activity(df: DataFrame, kind: str, name: str, moment: str) -> DataFrame:
        at = F.col(moment).cast("timestamp_ntz")
        return df.filter(at >= since).select(F.lit(kind).alias("type"), F.col(name).alias("name"), at.alias("date"))

    return (
        activity(t.users, "New User", "username", "created_at")
        .unionByName(activity(t.drives, "New Event", "event_name", "event_date"))
        .unionByName(activity(t.donations, "New Donation", "donor_name", "donation_date"))
        .orderBy(F.desc("date"), "type", "name")
        .limit(n)
    )


def user_activity(t: Tables, ordered: bool = False) -> DataFrame:
    """Users with the drives they organise or joined, newest users first."""
    organised = t.drives.groupBy(F.col("organiser_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    joined = t.drive_volunteers.groupBy(F.col("volunteer_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counts = organised.withColumn("role", F.lit("organiser")).unionByName(joined.withColumn("role", F.lit("volunteer")))
    users = t.users.join(counts, ["id", "role"], "left").select(
        "id", "username", "email", "mobile", "location", "role", "created_at", zero(F.col("n")).alias("activity_count")
    )
    return sorted_if(users, ordered, F.desc("created_at"), "id")


def drive_overview(t: Tables, ordered: bool = False) -> DataFrame:
    """Every drive with organiser and head count; upcoming first, then active, completed, others."""
    rank = (
        F.when(F.col("status") == "Upcoming", 1)
        .when(F.col("status") == "Active", 2)
        .when(F.col("status") == "Completed", 3)
        .otherwise(4)
    )
    organisers = t.users.select(F.col("id").alias("organiser_id"), F.col("username").alias("organiser_name"))
    heads = plastics_per_drive(t).select(F.col("event_id").alias("id"), "volunteer_count")
    drives = (
        t.drives.join(heads, "id", "left")
        .join(organisers, "organiser_id", "left")
        .select(*DRIVE_COLUMNS, "organiser_name", zero(F.col("volunteer_count")).alias("volunteer_count"))
    )
    return sorted_if(drives, ordered, rank, F.desc("event_date"), "id")


def donations_filtered(
    t: Tables,
    organiser: str | None = None,
    start: str | None = None,
    end: str | None = None,
    inclusive_end: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Donations with organiser name, optionally of one organiser and a date range.

    A bare end date means its midnight, so donations later that day are left out; ``inclusive_end`` takes them in.
    """
    organisers = t.users.select(F.col("id").alias("organiser_id"), F.col("username"))
    given = F.col("donation_date")
    latest = None
    if end:
        limit = F.lit(end).cast("timestamp_ntz")
        latest = given < limit + F.expr("interval 1 day") if inclusive_end else given <= limit
    found = (
        t.donations.join(organisers, "organiser_id", "left")
        .filter(
            all_of(
                [
                    F.col("username") == organiser if organiser else None,
                    given >= F.lit(start).cast("timestamp_ntz") if start else None,
                    latest,
                ]
            )
        )
        .select(
            "id",
            "donor_name",
            "donor_email",
            "donor_phone",
            "amount",
            "organiser_id",
            "donation_date",
            "status",
            F.coalesce("username", F.lit("Unknown")).alias("organiser_name"),
        )
    )
    return sorted_if(found, ordered, F.desc("donation_date"), "id")


def donations_total(donations: DataFrame) -> DataFrame:
    """Sum over a donation list, 0 when it is empty."""
    return donations.agg(zero(F.sum("amount")).alias("total_donations"))


def organiser_names(t: Tables) -> DataFrame:
    """Distinct organiser names for the filter list."""
    return t.users.filter(F.col("role") == "organiser").select("username").distinct()


def _with_plastics(t: Tables, drives: DataFrame) -> DataFrame:
    collected = plastics_per_drive(t).select(F.col("event_id").alias("id"), F.col("plastics_collected").alias("plastics"))
    return drives.join(collected, "id", "left")


def _recycled_totals(rows: DataFrame, key: str, finished: Column) -> DataFrame:
    """Per key: finished drives, plastics and recycled products.

    ``total_products_recycled`` counts equal figures of different drives once, as the original report does;
    ``..._fixed`` counts every drive.  Grouping by the figure first gives both from plain sums.
    """
    by_figure = rows.groupBy(key, "products_recycled").agg(
        F.count(F.lit(1)).alias("drives"), F.count_if(finished).alias("finished"), F.sum("plastics").alias("plastics")
    )
    return by_figure.groupBy(key).agg(
        F.sum("finished").alias("event_count"),
        zero(F.sum("plastics")).alias("plastics"),
        zero(F.sum("products_recycled")).alias("total_products_recycled"),
        zero(F.sum(F.col("products_recycled") * F.col("drives"))).alias("total_products_recycled_fixed"),
    )


def monthly_stats(t: Tables, months: int = MONTHS) -> DataFrame:
    """Completed drives per month, latest months first."""
    rows = _with_plastics(t, completed(t).withColumn("month", F.date_format("event_date", "yyyy-MM")))
    return (
        _recycled_totals(rows, "month", F.lit(True))
        .withColumnRenamed("plastics", "plastics_collected")
        .orderBy(F.desc("month"))
        .limit(months)
    )


def top_organizers(t: Tables, n: int = TOP) -> DataFrame:
    """Organisers by recycled products; only the drive count is limited to Completed drives."""
    rows = _with_plastics(t, t.drives.filter(F.col("organiser_id").isNotNull()))
    totals = _recycled_totals(rows, "organiser_id", F.col("status") == "Completed")
    return (
        t.users.filter(F.col("role") == "organiser")
        .join(totals, F.col("id") == F.col("organiser_id"), "left")
        .select(
            "id",
            "username",
            zero(F.col("event_count")).alias("event_count"),
            zero(F.col("plastics")).alias("total_plastics"),
            zero(F.col("total_products_recycled")).alias("total_products_recycled"),
            zero(F.col("total_products_recycled_fixed")).alias("total_products_recycled_fixed"),
        )
        .orderBy(F.desc("total_products_recycled"), "id")
        .limit(n)
        .drop("id")
    )


def completed_buyers(t: Tables, ordered: bool = False) -> DataFrame:
    """Completed purchases with their buyers, newest first."""
    buyers = t.users.select(
        F.col("id").alias("buyer_id"),
        F.col("username").alias("buyer_name"),
        F.col("email").alias("buyer_email"),
        F.col("mobile").alias("buyer_mobile"),
    )
    rows = t.purchases.filter(F.col("status") == "Completed").join(buyers, F.col("user_id") == F.col("buyer_id"))
    return sorted_if(rows, ordered, F.desc("purchase_date"), "id").select(
        *buyers.columns, "product_name", "price", "purchase_date", "status"
    )


def donations_export(t: Tables, ordered: bool = True) -> DataFrame:
    """The donation feed of the JSON export."""
    return donations_filtered(t, ordered=ordered).select("id", "donor_name", "amount", "donation_date", "organiser_name")


def month_labels(monthly: DataFrame) -> DataFrame:
    """Chart series of the monthly figures in chronological order with 'Sep 2024' labels."""
    first_day = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    return monthly.select(
        "month",
        F.date_format(first_day, "MMM yyyy").alias("label"),
        "event_count",
        "plastics_collected",
        "total_products_recycled",
    ).orderBy("month")


def pending_products(t: Tables) -> DataFrame:
    """Products waiting for review."""
    return t.products.filter(F.col("status") == "Pending").select(
        "id", "name", "description", "price", "category", "units", "quantity", "organiser_id", "image_path", "created_at"
    )
