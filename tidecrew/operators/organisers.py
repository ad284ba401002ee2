"""Reports of organisers and volunteers, for all of them at once.

What a page shows one signed-in person is here a key column: ``organiser_id`` or ``volunteer_id``.  Rows come out
unsorted unless ``ordered`` is set, because the order only matters inside one person's page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.functions import text
from tidecrew.operators.impact import DRIVE_COLUMNS, completed, plastics_per_drive, zero
from tidecrew.plans.combine import parts_for, sorted_if
from tidecrew.plans.durable import cut
from tidecrew.plans.running import dense_index, sorted_positions
from tidecrew.sources.catalog import Tables
from tidecrew.sources.mapping import AS_OF

# Badge types from lowest to highest.
BADGES = ("bronze", "gold", "platinum", "diamond")
# Drives of a block, and shares of the volunteers that a block is met with.
SPAN = 1024
SHARES = 16


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz").cast("date")


def _people(t: Tables, key: str, **names: str) -> DataFrame:
    """User columns under new names, keyed by ``key``."""
    return t.users.select(F.col("id").alias(key), *[F.col(c).alias(a) for c, a in names.items()])


def _heads(t: Tables) -> DataFrame:
    return plastics_per_drive(t).select(F.col("event_id").alias("id"), "volunteer_count")


def organiser_drives(t: Tables, as_of: str = AS_OF, ordered: bool = False) -> DataFrame:
    """Drives of every organiser; a missing status follows from the date."""
    day = _day(as_of)
    by_date = F.when(F.col("event_date") > day, "Upcoming").when(F.col("event_date") == day, "Active")
    drives = (
        t.drives.filter(F.col("organiser_id").isNotNull())
        .join(_heads(t), "id", "left")
        .withColumn("status", F.coalesce("status", by_date.otherwise("Completed")))
        .select(*DRIVE_COLUMNS, zero(F.col("volunteer_count")).alias("joined_volunteers"))
    )
    return sorted_if(drives, ordered, "organiser_id", F.desc("event_date"), "id")


def organiser_buyers(t: Tables, ordered: bool = False) -> DataFrame:
    """Who bought an organiser's products, whatever the purchase status."""
    buyers = _people(t, "buyer_id", username="buyer_name", email="buyer_email", mobile="buyer_mobile")
    sold = t.products.select(F.col("id").alias("product_id"), "organiser_id")
    rows = t.purchases.join(sold, "product_id").join(buyers, F.col("user_id") == F.col("buyer_id"))
    return sorted_if(rows, ordered, "organiser_id", F.desc("purchase_date"), "id").select(
        "organiser_id", *buyers.columns, "product_name", "price", "quantity", "purchase_date"
    )


def organiser_donors(t: Tables, ordered: bool = False) -> DataFrame:
    """Donations to every organiser, newest first."""
    rows = t.donations.filter(F.col("organiser_id").isNotNull())
    return sorted_if(rows, ordered, "organiser_id", F.desc("donation_date"), "id").select(
        "organiser_id", "donor_name", "donor_email", "amount", "donation_date", "status"
    )


def _future(t: Tables, as_of: str) -> DataFrame:
    return t.drives.filter(F.col("event_date") >= _day(as_of))


def joinable_drives(t: Tables, as_of: str = AS_OF, ordered: bool = False) -> DataFrame:
    """Drives from ``as_of`` on with organiser, place name and head count: the part every volunteer sees alike.

    Who joined is kept apart in :func:`joined_drives`, so nothing is written per pair of volunteer and drive.
    """
    organisers = _people(t, "organiser_id", username="organiser_name")
    drives = with_place(
        t, _future(t, as_of).join(_heads(t), "id", "left").join(organisers, "organiser_id"), "Location unavailable"
    ).select(*DRIVE_COLUMNS, "organiser_name", "location", zero(F.col("volunteer_count")).alias("joined_volunteers"))
    return sorted_if(drives, ordered, "event_date", "id")


def joined_drives(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """The (volunteer, drive) pairs whose ``is_joined`` flag is set among the joinable drives."""
    drives = _future(t, as_of).select(F.col("id").alias("event_id"), "organiser_id")
    known = drives.join(_people(t, "organiser_id"), "organiser_id", "left_semi").select("event_id")
    return t.drive_volunteers.join(known, "event_id", "left_semi").select("volunteer_id", "event_id").distinct()


def joinable_drives_for(t: Tables, volunteer_id: int, as_of: str = AS_OF) -> DataFrame:
    """The page of one volunteer: joinable drives with the ``is_joined`` flag."""
    mine = joined_drives(t, as_of).filter(F.col("volunteer_id") == volunteer_id)
    flags = mine.select(F.col("event_id").alias("id"), F.lit(True).alias("mine"))
    return (
        joinable_drives(t, as_of)
        .join(flags, "id", "left")
        .withColumn("is_joined", F.coalesce("mine", F.lit(False)))
        .drop("mine")
        .orderBy("event_date", "id")
    )


def joinable_flags(t: Tables, cohort: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """(volunteer_id, id, is_joined): the flag of every joinable drive on the page of every volunteer of ``cohort`` (volunteer_id).

    The drives are numbered and put in blocks of ``SPAN``, and what a volunteer has of a block is a bit per number, put together in
    the tasks; the sign-ups themselves are not met with the pages.  Volunteers meet the blocks, a row each, and the flags,
    a row per pair, are not shuffled.  They come out block by block and within it volunteer by volunteer, so that files of
    them repeat the same short list and stay small.
    """
    people = cut(cohort.select("volunteer_id").na.drop().distinct())
    drives = _future(t, as_of).select(F.col("id").alias("event_id"), "organiser_id")
    known = cut(drives.join(_people(t, "organiser_id"), "organiser_id", "left_semi").select("event_id"))
    places = cut(dense_index(known.na.drop(), "event_id", name="place"))
    last = max(0, places.count() - 1) // SPAN
    block = F.floor(F.col("place") / SPAN).alias("block")
    bit = F.col("place") % SPAN
    # A drive without an id has its page too, and nobody in it.
    entry = F.struct(bit.alias("bit"), "event_id")
    lists = known.join(places, "event_id", "left").groupBy(F.coalesce(block, F.lit(0)).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("drives"))
    joined = (
        t.drive_volunteers.select("event_id", "volunteer_id")
        .join(places.select("event_id"), "event_id", "left_semi")
        .join(people, "volunteer_id", "left_semi")
        .join(places, "event_id")
        .select("volunteer_id", block, F.floor(bit / 64).alias("word"), (bit % 64).cast("int").alias("bit"))
    )
    words = (
        joined.groupBy("volunteer_id", "block", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .groupBy("volunteer_id", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )
    pages = people.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))).join(
        words, ["volunteer_id", "block"], "left"
    )
    # Few bytes, but many rows each: the number of parts is given outright, and a block is met in several of them.
    keys = ["block", "share"]
    share = F.pmod(F.xxhash64("volunteer_id"), F.lit(SHARES)).cast("int")
    shared = lists.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = pages.withColumn("share", share).repartition(parts_for(t.spark), *keys).join(shared, keys)
    each = met.select("volunteer_id", "words", F.posexplode("drives").alias("nth", "drive")).select("volunteer_id", "words", "drive.bit", "drive.event_id")
    flag = F.getbit(F.element_at("words", F.floor(F.col("bit") / 64)), (F.col("bit") % 64).cast("int")) == 1
    return each.select("volunteer_id", F.col("event_id").alias("id"), F.coalesce(flag, F.lit(False)).alias("is_joined"))


def drive_capacity(t: Tables) -> DataFrame:
    """Whether a drive still takes volunteers."""
    joined = zero(F.col("volunteer_count"))
    return t.drives.join(_heads(t), "id", "left").select(
        "id",
        "num_volunteers",
        joined.alias("joined_volunteers"),
        F.when(joined >= F.col("num_volunteers"), "full").otherwise("open").alias("capacity"),
    )


def supplies_list(t: Tables) -> DataFrame:
    """One row per drive and supply, numbered in the order given."""
    return t.drives.filter(~text.is_blank("supplies")).select(
        "id", F.posexplode(F.split("supplies", ",")).alias("position", "supply")
    )


def supplies_text(items: DataFrame) -> DataFrame:
    """The comma text of each drive's supplies, the inverse of :func:`supplies_list`."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "supply")))
    return items.groupBy("id").agg(F.array_join(F.transform(ordered, lambda s: s["supply"]), ",").alias("supplies"))


def badge_history(t: Tables, ordered: bool = False) -> DataFrame:
    """Badges of every volunteer with the drive they were earned on."""
    drives = t.drives.select(F.col("id").alias("event_id"), "event_name")
    rows = t.volunteer_badges.join(drives, "event_id")
    return sorted_if(rows, ordered, "volunteer_id", F.desc("awarded_date"), "event_id").select(
        "volunteer_id", "badge_type", F.date_format("awarded_date", "yyyy-MM-dd").alias("awarded_date"), "event_name"
    )


def badge_counts(t: Tables) -> DataFrame:
    """Badges per volunteer and type; the type must match exactly."""
    counts = [F.count_if(F.col("badge_type") == badge).alias(badge) for badge in BADGES]
    return t.volunteer_badges.groupBy("volunteer_id").agg(*counts)


def drive_roster(t: Tables) -> DataFrame:
    """Volunteers of every drive with the badge earned on that drive."""
    people = _people(t, "volunteer_id", username="username", email="email", mobile="mobile", location="location")
    badges = t.volunteer_badges.select("volunteer_id", "event_id", "badge_type")
    return (
        t.drive_volunteers.join(people, "volunteer_id")
        .join(badges, ["volunteer_id", "event_id"], "left")
        .select("event_id", "volunteer_id", "username", "email", "mobile", "location", "joined_date", "badge_type")
    )


def _payment(hours: str = "hours_worked", salary: str = "salary_per_volunteer") -> Column:
    return (F.col(hours) * F.col(salary)).cast("decimal(18,2)")


def organiser_completed_totals(t: Tables, fixed: bool = False) -> DataFrame:
    """Plastics, recycled products and paid wages of each organiser's Completed drives.

    The original sums a drive's products once per volunteer; ``fixed`` counts every drive once.
    """
    # A volunteer's pay depends on the drive's salary only, so the hours can be summed before the join.
    work = t.drive_volunteers.groupBy("event_id").agg(
        F.sum("plastics_collected").alias("plastics"),
        F.count(F.lit(1)).alias("heads"),
        F.sum(F.when(F.col("payment_status") == "Paid", F.col("hours_worked"))).alias("paid_hours"),
    )
    copies = F.lit(1) if fixed else F.coalesce("heads", F.lit(1))
    return (
        completed(t)
        .filter(F.col("organiser_id").isNotNull())
        .join(work, F.col("id") == F.col("event_id"), "left")
        .groupBy("organiser_id")
        .agg(
            zero(F.sum("plastics")).alias("total_plastics"),
            zero(F.sum(F.col("products_recycled") * copies)).alias("total_products"),
            zero(F.sum(_payment("paid_hours"))).alias("total_payments"),
        )
    )


def organiser_completed_drives(t: Tables, ordered: bool = False) -> DataFrame:
    """Completed drives of every organiser with their head count."""
    drives = (
        completed(t)
        .filter(F.col("organiser_id").isNotNull())
        .join(_heads(t), "id", "left")
        .select(*DRIVE_COLUMNS, zero(F.col("volunteer_count")).alias("volunteer_count"))
    )
    return sorted_if(drives, ordered, "organiser_id", F.desc("event_date"), "id")


def drive_payroll(t: Tables) -> DataFrame:
    """Hours, plastics and pay of every volunteer of every organiser's Completed drives."""
    drives = (
        completed(t)
        .filter(F.col("organiser_id").isNotNull())
        .select(F.col("id").alias("event_id"), "organiser_id", "salary_per_volunteer")
    )
    return (
        t.drive_volunteers.join(drives, "event_id")
        .join(_people(t, "volunteer_id", username="username"), "volunteer_id")
        .select(
            "organiser_id",
            "event_id",
            "volunteer_id",
            "username",
            "hours_worked",
            "plastics_collected",
            _payment().alias("payment_due"),
            F.coalesce("payment_status", F.lit("Pending")).alias("payment_status"),
        )
    )


def drive_total_plastics(t: Tables) -> DataFrame:
    """Collected plastics per drive that has volunteers."""
    return plastics_per_drive(t).select("event_id", zero(F.col("plastics_collected")).alias("total_plastics"))


def volunteer_history(t: Tables, ordered: bool = False) -> DataFrame:
    """Completed drives of every volunteer with organiser and pay."""
    organisers = _people(
        t, "organiser_id", username="organiser_name", email="organiser_email", mobile="organiser_mobile"
    )
    drives = completed(t).join(organisers, "organiser_id").withColumnRenamed("plastics_collected", "drive_plastics")
    rows = t.drive_volunteers.join(drives, F.col("event_id") == F.col("id"))
    return sorted_if(rows, ordered, "volunteer_id", F.desc("event_date"), "id").select(
        "volunteer_id",
        "id",
        "event_name",
        "event_date",
        "event_time",
        "photo_path",
        "salary_per_volunteer",
        "hours_worked",
        "payment_status",
        "organiser_name",
        "organiser_email",
        "organiser_mobile",
        _payment().alias("total_payment"),
        F.col("drive_plastics").alias("plastics_collected"),
        "products_recycled",
        F.coalesce(F.col("hours_worked").cast("string"), F.lit("Not recorded")).alias("hours_text"),
        F.coalesce("payment_status", F.lit("Pending")).alias("payment_text"),
    )


def drive_volunteer_names(t: Tables) -> DataFrame:
    """Completed drives with the names of their volunteers, a row for each in sorted order; one without is NULL.

    Numbered rows keep this shape for three volunteers and for three million; :func:`volunteer_name_list` gives the
    text list of one drive.
    """
    drives = completed(t).filter(F.col("organiser_id").isNotNull())
    joined = t.drive_volunteers.select("event_id", "volunteer_id").join(
        drives.select(F.col("id").alias("event_id")), "event_id", "left_semi"
    )
    named = joined.join(_people(t, "volunteer_id", username="volunteer_name"), "volunteer_id").select(
        "event_id", "volunteer_id", "volunteer_name"
    )
    names = sorted_positions(named, ["event_id"], [F.col("volunteer_name"), F.col("volunteer_id")], "position")
    return (
        drives.join(names, F.col("id") == F.col("event_id"), "left")
        .select("organiser_id", "id", "event_name", "event_date", "status", "position", "volunteer_name")
    )


def volunteer_name_list(t: Tables, drive: int) -> DataFrame:
    """The names of one drive's volunteers as a sorted comma list."""
    one = t.drive_volunteers.filter(F.col("event_id") == drive).join(
        _people(t, "volunteer_id", username="username"), "volunteer_id"
    )
    return one.agg(F.array_join(F.sort_array(F.collect_list("username")), ",").alias("volunteer_names"))


def _feedback(t: Tables) -> DataFrame:
    drives = t.drives.select(F.col("id").alias("event_id"), "organiser_id", "event_name", "event_date").filter(
        F.col("organiser_id").isNotNull()
    )
    return t.drive_feedback.join(drives, "event_id").join(
        _people(t, "volunteer_id", username="volunteer_name"), "volunteer_id"
    )


def organiser_feedback(t: Tables, ordered: bool = False) -> DataFrame:
    """Feedback on every organiser's drives, newest first."""
    return sorted_if(
        _feedback(t), ordered, "organiser_id", F.desc("submission_date"), "event_id", "volunteer_id"
    ).select("organiser_id", "event_name", "volunteer_name", "rating", "feedback_text", "submission_date", "event_date")


def feedback_stats(t: Tables) -> DataFrame:
    """Feedback count and average rating (one decimal, 0 without feedback) per organiser."""
    stats = (
        _feedback(t).groupBy("organiser_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))
    )
    average = F.round(F.col("total").cast("decimal(20,0)") / F.col("n").cast("decimal(20,0)"), 1)
    return (
        t.users.filter(F.col("role") == "organiser")
        .select(F.col("id").alias("organiser_id"))
        .join(stats, "organiser_id", "left")
        .select(
            "organiser_id",
            zero(F.col("n")).alias("total_feedbacks"),
            zero(average.cast("double")).alias("average_rating"),
        )
    )


def feedback_by_drive(t: Tables, by_name: bool = False) -> DataFrame:
    """Completed drives with their feedback; a drive without any has one row with NULL feedback.

    The page matches feedback by drive *name* within an organiser, so equal names share feedback; ``by_name`` gives
    that form as one row per (organiser, name) instead of repeating the feedback for every namesake.
    """
    drives = completed(t).filter(F.col("organiser_id").isNotNull())
    if by_name:
        names = drives.select("organiser_id", "event_name").groupBy("organiser_id", "event_name").agg(
            F.count(F.lit(1)).alias("namesakes")
        )
        rows = _feedback(t).select("organiser_id", "event_name", "volunteer_name", "rating", "feedback_text")
        return names.join(rows, ["organiser_id", "event_name"], "left")
    people = _people(t, "volunteer_id", username="volunteer_name")
    rows = t.drive_feedback.join(people, "volunteer_id").select(
        F.col("event_id").alias("id"), "volunteer_name", "rating", "feedback_text"
    )
    return drives.select("organiser_id", "id", "event_name").join(rows, "id", "left")


def organiser_directory(t: Tables, fixed: bool = False, ordered: bool = True) -> DataFrame:
    """Organisers to donate to, most Completed drives first.

    The original sums a drive column nothing writes; ``fixed`` sums what the volunteers collected.
    """
    drives = completed(t).select("id", "organiser_id", "plastics_collected")
    if fixed:
        collected = plastics_per_drive(t).select(F.col("event_id").alias("id"), "plastics_collected")
        drives = drives.drop("plastics_collected").join(collected, "id", "left")
    per_organiser = drives.groupBy(F.col("organiser_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("plastics_collected").alias("plastics")
    )
    rows = (
        t.users.filter(F.col("role") == "organiser")
        .join(per_organiser, "id", "left")
        .select(
            "id",
            "username",
            "email",
            "mobile",
            "location",
            zero(F.col("n")).alias("total_events"),
            zero(F.col("plastics")).alias("total_plastics_collected"),
        )
    )
    return sorted_if(rows, ordered, F.desc("total_events"), "id")


def organiser_directory_any_status(t: Tables) -> DataFrame:
    """The older directory: drives of every status, no 0 for an empty sum."""
    per_organiser = t.drives.groupBy(F.col("organiser_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("plastics_collected").alias("total_plastics_collected")
    )
    return (
        t.users.filter(F.col("role") == "organiser")
        .join(per_organiser, "id", "left")
        .select("id", "username", "email", "mobile", "location", zero(F.col("n")).alias("total_events"), "total_plastics_collected")
    )


def organiser_products(t: Tables) -> DataFrame:
    """Organisers with Completed drives and recycled products; coordinates become place names."""
    per_organiser = (
        completed(t)
        .groupBy(F.col("organiser_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("products_recycled").alias("products"))
    )
    rows = t.users.filter(F.col("role") == "organiser").join(per_organiser, "id", "left")
    return named_location(t, rows).select(
        "id",
        "username",
        "email",
        "mobile",
        "location",
        "created_at",
        zero(F.col("n")).alias("total_events"),
        zero(F.col("products")).alias("total_products"),
    )


def _named_cells(t: Tables) -> DataFrame:
    """(_lat, _lon, display_name): one name for coordinates that are equal to four decimals, the first of several."""
    at = [F.round(c, 4).alias(name) for c, name in (("latitude", "_lat"), ("longitude", "_lon"))]
    return t.places.groupBy(*at).agg(F.min("display_name").alias("display_name"))


def with_place(t: Tables, rows: DataFrame, fallback: str) -> DataFrame:
    """Add ``location``: the stored place name at the row's coordinates."""
    places = _named_cells(t)
    at = (F.round(F.col("latitude"), 4) == F.col("_lat")) & (F.round(F.col("longitude"), 4) == F.col("_lon"))
    return rows.join(places, at, "left").withColumn("location", F.coalesce("display_name", F.lit(fallback)))


def named_location(t: Tables, rows: DataFrame) -> DataFrame:
    """Replace a 'lat,lon' location by its place name and an empty one by a fallback; keep other texts."""
    given = F.col("location")
    places = _named_cells(t)
    at = (F.round(text.latitude(given), 4) == F.col("_lat")) & (F.round(text.longitude(given), 4) == F.col("_lon"))
    name = (
        F.when(text.is_blank(given), text.NO_LOCATION)
        .when(given.contains(","), F.coalesce("display_name", given))
        .otherwise(given)
    )
    return rows.join(places, at, "left").withColumn("location", name).drop("_lat", "_lon", "display_name")


def user_locations(t: Tables) -> DataFrame:
    """Every user's location: coordinates, place name and display form."""
    raw = t.users.select("id", F.col("location").alias("given"), "location")
    return named_location(t, raw).select(
        "id",
        text.latitude(F.col("given")).alias("latitude"),
        text.longitude(F.col("given")).alias("longitude"),
        "location",
        text.title_location(F.col("given")).alias("title"),
    )


def addresses(t: Tables) -> DataFrame:
    """Formatted address of every stored geocoder answer."""
    return t.geocoder_responses.select("id", text.format_address(F.col("response")).alias("address"))


def donation_receipt(t: Tables, donation_id: int | None = None) -> DataFrame:
    """Donations with their organiser; those without one have no receipt."""
    rows = t.donations if donation_id is None else t.donations.filter(F.col("id") == donation_id)
    return rows.join(_people(t, "organiser_id", username="organiser_name"), "organiser_id").select(
        "id", "donor_name", "donor_email", "donor_phone", "amount", "organiser_id", "donation_date", "status", "organiser_name"
    )


def public_drives(t: Tables, as_of: str = AS_OF, ordered: bool = True) -> DataFrame:
    """Drives from ``as_of`` on for the public page, earliest first."""
    rows = _future(t, as_of).join(_people(t, "organiser_id", username="organizer_name"), "organiser_id")
    listed = rows.withColumn("photo_path", text.clean_path(F.col("photo_path"))).select(*DRIVE_COLUMNS, "organizer_name")
    return sorted_if(listed, ordered, "event_date", "event_time", "id")


def _organiser_sales(t: Tables) -> DataFrame:
    sold = t.products.select(F.col("id").alias("product_id"), "organiser_id")
    return t.purchases.filter(F.col("status") == "Completed").join(sold, "product_id")


def buyer_summary(t: Tables) -> DataFrame:
    """Per organiser and buyer e-mail: spending by unit price, purchases, last date, name from the newest purchase."""
    # Per user first: the user table then meets one row per (organiser, user).
    per_user = (
        _organiser_sales(t)
        .groupBy("organiser_id", "user_id")
        .agg(
            F.sum("price").alias("amount"),
            F.count(F.lit(1)).alias("n"),
            F.max(F.struct("purchase_date", "id")).alias("last"),
        )
    )
    people = _people(t, "user_id", username="username", email="email", mobile="mobile")
    newest = F.max(F.struct("last", "username", "mobile"))
    return (
        per_user.join(people, "user_id")
        .groupBy("organiser_id", "email")
        .agg(F.sum("amount").alias("total_amount"), F.sum("n").alias("total_products"), newest.alias("newest"))
        .select(
            "organiser_id",
            "email",
            F.col("newest.username").alias("username"),
            F.col("newest.mobile").alias("mobile"),
            F.round("total_amount", 2).alias("total_amount"),
            "total_products",
            F.col("newest.last.purchase_date").alias("last_purchase_date"),
        )
    )


def buyer_products(t: Tables) -> DataFrame:
    """The distinct product names each buyer bought from each organiser, a numbered row for each in sorted order."""
    people = _people(t, "user_id", email="email")
    names = (
        _organiser_sales(t)
        .select("organiser_id", "user_id", "product_name")
        .distinct()
        .join(people, "user_id")
        .select("organiser_id", "email", "product_name")
        .distinct()
    )
    return sorted_positions(names, ["organiser_id", "email"], [F.col("product_name")], "position")
