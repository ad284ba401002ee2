"""Change jobs: a batch of requests against the current tables gives verdicts and new table versions.

Files have no in-place update, so a change writes a new version of a table by joins and unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.functions import pricing, text
from tidecrew.operators.impact import zero
from tidecrew.plans.keyed import (
    Change,
    first_failure,
    flag_existing,
    keyed_update,
    last_request,
    numbered_after,
    with_standing,
    with_winner,
)
from tidecrew.plans.rationing import ration
from tidecrew.plans.running import sorted_positions
from tidecrew.sources.catalog import Tables
from tidecrew.sources.mapping import AS_OF


# Fixed value: the answer to a withdrawal that exceeds the stock.
REFUSED = "Insufficient quantity"


def _any_blank(*columns: str) -> Column:
    blank = F.lit(False)
    for name in columns:
        blank = blank | text.is_blank(F.col(name).cast("string"))
    return blank


def _moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _appended(current: DataFrame, rows: DataFrame) -> DataFrame:
    """``current`` and new rows cast to its columns; missing ones are NULL."""
    typed = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in current.schema.fields
    ]
    return current.unionByName(rows.select(*typed))


# Users


def register_users(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """New accounts: every field is required, an e-mail address registers once."""
    blank = _any_blank("username", "email", "mobile", "location", "role")
    rows = flag_existing(requests, t.users, ["email"], "taken")
    rows = with_winner(rows, ["email"], ~blank & ~F.col("taken"))
    reason = first_failure(
        (blank, "All fields are required."),
        (F.col("taken") | (F.col("winner") < F.col("request_id")), "Email already exists."),
    )
    verdicts = rows.withColumn("reason", reason).drop("taken", "winner")
    new = numbered_after(verdicts.filter(F.col("reason").isNull()), "request_id", t.users)
    return Change(verdicts, {"users": _appended(t.users, new.withColumn("created_at", _moment(as_of)))})


def update_users(t: Tables, batch: DataFrame) -> DataFrame:
    """Users with name, e-mail, mobile, location and role replaced."""
    return keyed_update(t.users, batch, ["id"], ["username", "email", "mobile", "location", "role"])


def delete_users(t: Tables, requests: DataFrame, buyers_only: bool = False, cascade: bool = True) -> dict[str, DataFrame]:
    """Users and purchases that stay.

    With ``buyers_only`` the purchases of every requested user go, but only buyers' accounts; without ``cascade`` the
    purchases stay.
    """
    gone = requests.select("user_id").distinct()
    accounts = gone.withColumnRenamed("user_id", "id")
    users = t.users
    if buyers_only:
        accounts = users.filter(F.col("role") == "buyer").join(accounts, "id", "left_semi").select("id")
    return {
        "users": users.join(accounts, "id", "left_anti"),
        "purchases": t.purchases.join(gone, "user_id", "left_anti") if cascade else t.purchases,
    }


# Drives


def create_drives(t: Tables, requests: DataFrame) -> DataFrame:
    """The drives to add: numbered, and Upcoming whatever their date."""
    return numbered_after(requests, "request_id", t.drives).withColumn("status", F.lit("Upcoming"))


def update_drives(t: Tables, requests: DataFrame) -> Change:
    """Six columns of a drive, replaced only by the organiser who owns it."""
    owned = t.drives.select("id", F.col("organiser_id").alias("owner"))
    rows = requests.join(owned, "id", "left")
    missed = F.col("owner").isNull() | ~F.col("owner").eqNullSafe(F.col("organiser_id"))
    verdicts = rows.withColumn(
        "reason", first_failure((missed, "No event was updated. Please check the event ID."))
    ).drop("owner")
    columns = ["event_name", "event_date", "event_time", "num_volunteers", "salary_per_volunteer", "status"]
    batch = verdicts.filter(F.col("reason").isNull())
    return Change(verdicts, {"drives": keyed_update(t.drives, batch, ["id"], columns)})


def delete_drives(
    t: Tables, requests: DataFrame, check_owner_first: bool = True, admin: bool = False
) -> dict[str, DataFrame]:
    """Drives and their badges, feedback and volunteers that stay.

    The original removes the children of any requested drive and checks the owner for the drive row only
    (``check_owner_first=False``).  The ``admin`` form checks no owner and leaves the badges.
    """
    asked = requests.select("event_id").distinct()
    owned = (
        t.drives.select(F.col("id").alias("event_id"), "organiser_id")
        .join(requests.select("event_id", "organiser_id").distinct(), ["event_id", "organiser_id"], "left_semi")
        .select("event_id")
    )
    drives = asked if admin else owned
    children = owned if check_owner_first and not admin else asked
    return {
        "drives": t.drives.join(drives.withColumnRenamed("event_id", "id"), "id", "left_anti"),
        "drive_volunteers": t.drive_volunteers.join(children, "event_id", "left_anti"),
        "drive_feedback": t.drive_feedback.join(children, "event_id", "left_anti"),
        "volunteer_badges": t.volunteer_badges if admin else t.volunteer_badges.join(children, "event_id", "left_anti"),
    }


def join_drives(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """Sign-ups, one per drive and volunteer."""
    pair = ["event_id", "volunteer_id"]
    rows = flag_existing(requests, t.drive_volunteers, pair, "joined")
    rows = with_winner(rows, pair, ~F.col("joined"))
    repeat = F.col("joined") | (F.col("winner") < F.col("request_id"))
    verdicts = rows.withColumn("reason", first_failure((repeat, "You have already joined this event."))).drop(
        "joined", "winner"
    )
    new = verdicts.filter(F.col("reason").isNull()).withColumn("joined_date", _moment(as_of))
    return Change(verdicts, {"drive_volunteers": _appended(t.drive_volunteers, new)})


def award_badges(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """One badge per volunteer and drive, given by the organiser of a Completed drive."""
    pair = ["volunteer_id", "event_id"]
    missing = _any_blank("volunteer_id", "event_id", "badge_type")
    done = t.drives.filter(F.col("status") == "Completed").select(
        F.col("id").alias("event_id"), F.col("organiser_id").alias("owner")
    )
    stranger = F.col("owner").isNull() | F.col("organiser_id").isNull() | (F.col("owner") != F.col("organiser_id"))
    rows = with_standing(requests.join(done, "event_id", "left"), t.volunteer_badges, pair, ~missing & ~stranger, "awarded")
    reason = first_failure(
        (missing, "Missing required data"),
        (F.col("awarded") | (F.col("winner") < F.col("request_id")), "Badge already awarded"),
        (stranger, "Unauthorized or event not completed"),
    )
    verdicts = rows.withColumn("reason", reason).drop("awarded", "owner", "winner")
    new = numbered_after(verdicts.filter(F.col("reason").isNull()), "request_id", t.volunteer_badges)
    badges = _appended(t.volunteer_badges, new.withColumn("awarded_date", _moment(as_of)))
    return Change(verdicts, {"volunteer_badges": badges})


def record_plastics(t: Tables, batch: DataFrame) -> DataFrame:
    """Participation with the collected plastics set."""
    return keyed_update(t.drive_volunteers, batch, ["event_id", "volunteer_id"], ["plastics_collected"])


def record_hours(t: Tables, batch: DataFrame) -> DataFrame:
    """Participation with the hours set."""
    return keyed_update(t.drive_volunteers, batch, ["event_id", "volunteer_id"], ["hours_worked"])


def mark_paid(t: Tables, batch: DataFrame) -> DataFrame:
    """Participation marked as paid."""
    paid = batch.select("event_id", "volunteer_id").distinct().withColumn("payment_status", F.lit("Paid"))
    return keyed_update(t.drive_volunteers, paid, ["event_id", "volunteer_id"], ["payment_status"])


def record_work(t: Tables, batch: DataFrame) -> DataFrame:
    """Plastics, hours and payment of a batch in one pass."""
    paid = batch.withColumn("payment_status", F.lit("Paid"))
    return keyed_update(
        t.drive_volunteers, paid, ["event_id", "volunteer_id"], ["plastics_collected", "hours_worked", "payment_status"]
    )


def record_products(t: Tables, requests: DataFrame) -> Change:
    """Recycled products of a drive, set by its organiser."""
    owned = t.drives.select(F.col("id").alias("event_id"), F.col("organiser_id").alias("owner"))
    missing = text.is_blank(F.col("products_recycled").cast("string"))
    stranger = F.col("owner").isNull() | ~F.col("owner").eqNullSafe(F.col("organiser_id"))
    verdicts = (
        requests.join(owned, "event_id", "left")
        .withColumn(
            "reason",
            first_failure(
                (missing, "Products recycled value is required"), (stranger, "Event not found or unauthorized")
            ),
        )
        .drop("owner")
    )
    batch = verdicts.filter(F.col("reason").isNull()).withColumnRenamed("event_id", "id")
    return Change(verdicts, {"drives": keyed_update(t.drives, batch, ["id"], ["products_recycled"])})


# Products


def review_products(t: Tables, batch: DataFrame) -> DataFrame:
    """Products with a new review status."""
    return keyed_update(t.products, batch, ["id"], ["status"])


def upload_products(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """New products: the first rule that fails gives the reason; an organiser lists a name once."""
    rows = requests.withColumns(
        {
            "name": F.trim("name"),
            "product_type": F.lower(F.trim("product_type")),
            "description": F.trim("description"),
            "price_value": F.col("price").try_cast("double"),
            "quantity_value": F.col("quantity").try_cast("double"),
        }
    )
    kind, value = F.col("product_type"), F.col("quantity_value")
    pieces = F.when(kind == "recycled", F.signum(value) * F.floor(F.abs(value))).otherwise(value)
    required = [
        (text.is_blank(column), f"{label} is required")
        for column, label in (
            ("name", "Product name"),
            ("product_type", "Product type"),
            ("price", "Price"),
            ("quantity", "Quantity"),
            ("description", "Description"),
        )
    ]
    later = [
        (F.col("price_value").isNull(), "Invalid price format. Please enter a valid number."),
        (F.col("price_value") <= 0, "Price must be greater than 0"),
        (
            (kind == "wholesale") & value.isNull(),
            "For wholesale products, quantity must be a valid number in kilograms",
        ),
        ((kind == "recycled") & value.isNull(), "For recycled products, quantity must be a whole number"),
        (
            ~kind.isin("wholesale", "recycled"),
            F.concat(F.lit("Invalid product type: "), kind, F.lit(". Must be wholesale or recycled.")),
        ),
        (pieces <= 0, "Quantity must be greater than 0"),
        (F.col("file_name").isNull(), "Please upload a product image"),
        (F.col("file_name") == "", "No image selected"),
        (~text.image_extension_ok(F.col("file_name")), "Invalid image format"),
    ]
    listed = t.products.filter(F.col("status") != "Deleted").select("organiser_id", "name")
    rows = flag_existing(rows, listed, ["organiser_id", "name"], "listed")
    rows = rows.withColumn("fault", first_failure(*required, *later))
    rows = with_winner(rows, ["organiser_id", "name"], F.col("fault").isNull() & ~F.col("listed"))
    duplicate = F.col("listed") | (F.col("winner") < F.col("request_id"))
    reason = first_failure(
        *required, (duplicate, "A product with this name already exists in your inventory"), *later
    )
    verdicts = rows.withColumn("reason", reason).select(
        "request_id",
        "organiser_id",
        "name",
        F.col("price_value").cast("decimal(10,2)").alias("price"),
        "description",
        kind.alias("category"),
        F.when(kind == "wholesale", "kg").when(kind == "recycled", "units").alias("units"),
        pieces.cast("decimal(12,2)").alias("quantity"),
        F.col("file_name").alias("image_path"),
        "reason",
    )
    new = numbered_after(verdicts.filter(F.col("reason").isNull()), "request_id", t.products).withColumns(
        {"status": F.lit("Pending"), "created_at": _moment(as_of)}
    )
    return Change(verdicts, {"products": _appended(t.products, new)})


def _less_stock(products: DataFrame, taken: DataFrame) -> DataFrame:
    """Products with ``taken`` (product_id, taken) subtracted from their stock."""
    used = taken.select(F.col("product_id").alias("id"), "taken")
    return (
        products.join(used, "id", "left")
        .withColumn("quantity", (F.col("quantity") - zero(F.col("taken"))).cast(products.schema["quantity"].dataType))
        .select(*products.columns)
    )


def apply_purchases(t: Tables, requests: DataFrame, strict: bool = False, as_of: str = AS_OF) -> Change:
    """Direct purchases at badge prices.

    The original never compares the quantity with the stock, which can go below zero; ``strict`` serves the requests in
    order as far as the stock lasts.
    """
    listed = t.products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "price", F.col("quantity").alias("stock")
    )
    percent = zero(F.col("discount_pct"))
    rows = requests.join(listed, "product_id", "left").join(pricing.badge_discounts(t), "user_id", "left")
    rules = [
        (F.col("product_id").isNull(), "Product ID is required"),
        (F.col("product_name").isNull(), "Product not found"),
        (F.col("stock").isNull(), "Stock unknown"),
    ]
    if strict:
        lines = requests.select(F.col("request_id").alias("unit"), "product_id", "quantity")
        stock = t.products.select(F.col("id").alias("product_id"), F.col("quantity").alias("stock"))
        served = ration(lines, stock).select(F.col("unit").alias("request_id"), "served")
        rows = rows.join(served, "request_id", "left")
        rules.append((~F.col("served"), "Insufficient stock"))
    verdicts = rows.select(
        "request_id",
        "user_id",
        "product_id",
        "product_name",
        "quantity",
        "price",
        pricing.badge_price(F.col("price"), percent).alias("discounted_price"),
        F.round(F.col("price") * (100 - percent) * F.col("quantity") / 100, 2).cast("decimal(14,2)").alias("total_amount"),
        "from_cart",
        first_failure(*rules).alias("reason"),
    )
    accepted = verdicts.filter(F.col("reason").isNull())
    bought = numbered_after(accepted, "request_id", t.purchases).withColumns(
        {"purchase_date": _moment(as_of), "status": F.lit("Completed")}
    )
    taken = accepted.groupBy("product_id").agg(F.sum("quantity").alias("taken"))
    from_cart = accepted.filter(F.col("from_cart")).select("user_id", "product_id").distinct()
    return Change(
        verdicts,
        {
            "purchases": _appended(t.purchases, bought),
            "products": _less_stock(t.products, taken),
            "cart": t.cart.join(from_cart, ["user_id", "product_id"], "left_anti"),
        },
    )


# Cart and checkout


def add_to_cart(t: Tables, requests: DataFrame) -> Change:
    """Pieces added one by one to a cart line, up to the stock.

    Adding a piece again and again to one line is decided per line: of ``asked`` requests the first ``added`` succeed.
    The first piece of a new line only needs stock above zero.
    """
    asked = requests.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("asked"))
    listed = t.products.select(
        F.col("id").alias("product_id"),
        F.col("name").alias("new_name"),
        F.col("quantity").alias("stock"),
        F.col("price").alias("new_price"),
        F.col("discounted_price").alias("offer"),
    )
    lines = t.cart.select("user_id", "product_id", F.col("quantity").alias("present"))
    roles = t.users.select(F.col("id").alias("user_id"), "role")
    rows = (
        asked.join(listed, "product_id", "left")
        .join(lines, ["user_id", "product_id"], "left")
        .join(roles, "user_id", "left")
    )
    room = F.greatest(F.floor("stock") - zero(F.col("present")), F.when(F.col("present").isNull(), 1).otherwise(0))
    no_stock = F.col("stock").isNull() | (F.col("stock") <= 0)
    added = F.when(F.col("new_name").isNull() | no_stock, 0).otherwise(F.least("asked", room)).cast("bigint")
    verdicts = rows.withColumn("added", added).select(
        "user_id",
        "product_id",
        "asked",
        "added",
        F.col("new_name").alias("product_name"),
        (zero(F.col("present")) + F.col("added")).alias("quantity"),
        F.col("new_price").alias("price"),
        F.when(F.col("role") == "volunteer", F.col("offer")).alias("discounted_price"),
        first_failure(
            (F.col("new_name").isNull(), "Product not found"),
            (no_stock, "Product is out of stock"),
            (F.col("added") < F.col("asked"), "Requested quantity exceeds available stock"),
        ).alias("reason"),
    )
    changed = verdicts.filter(F.col("added") > 0)
    kept = t.cart.join(changed, ["user_id", "product_id"], "left_anti")
    # A line that existed keeps its stored name.
    names = t.cart.select("user_id", "product_id", F.col("product_name").alias("stored"))
    renamed = changed.join(names, ["user_id", "product_id"], "left").withColumn(
        "product_name", F.coalesce("stored", "product_name")
    )
    return Change(verdicts, {"cart": _appended(kept, renamed)})


def set_cart_quantity(t: Tables, requests: DataFrame) -> Change:
    """New quantities of cart lines, between one and the stock; the last of several stays."""
    listed = t.products.select(F.col("id").alias("product_id"), F.lit(True).alias("known"), F.col("quantity").alias("stock"))
    short = F.col("stock").isNull() | (F.col("quantity") > F.col("stock"))
    verdicts = (
        requests.join(listed, "product_id", "left")
        .withColumn(
            "reason",
            first_failure(
                (F.col("known").isNull(), "Product not found"),
                (F.col("quantity") < 1, "Quantity must be at least 1"),
                (short, "Requested quantity not available"),
            ),
        )
        .drop("known", "stock")
    )
    batch = last_request(verdicts.filter(F.col("reason").isNull()).drop("reason"), ["user_id", "product_id"])
    return Change(verdicts, {"cart": keyed_update(t.cart, batch, ["user_id", "product_id"], ["quantity"])})


def remove_from_cart(t: Tables, requests: DataFrame) -> DataFrame:
    """Cart lines that stay."""
    return t.cart.join(requests.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")


def validate_checkout(t: Tables, lines: DataFrame) -> DataFrame:
    """Per cart the message of its first failing line, or that it may proceed."""
    listed = t.products.select(F.col("id").alias("product_id"), "name", F.col("quantity").alias("stock"))
    message = first_failure(
        (F.col("product_id").isNull() | F.col("quantity").isNull(), "Invalid cart item structure"),
        (
            F.col("name").isNull(),
            F.concat(F.lit("Product ID "), F.col("product_id").cast("string"), F.lit(" does not exist")),
        ),
        (
            F.col("stock").isNull() | (F.col("stock") < F.col("quantity")),
            F.concat(F.lit("Insufficient stock for "), F.col("name")),
        ),
    )
    judged = lines.join(listed, "product_id", "left").withColumn("message", message)
    first = F.min(F.when(F.col("message").isNotNull(), F.struct("line_no", "message")))
    return (
        judged.groupBy("cart_id")
        .agg(first.alias("first"))
        .select(
            "cart_id",
            F.col("first").isNull().alias("success"),
            F.coalesce("first.message", F.lit("Proceeding to checkout")).alias("message"),
        )
    )


def checkout_carts(t: Tables, as_of: str = AS_OF) -> Change:
    """All carts bought at once: a cart goes through whole or not at all.

    Carts are served in the order of the MD5 of their user id.  Any order would do, since nobody is first in a batch;
    by user id a long chain of neighbours who share a product would take as many rounds as it has carts.
    """
    listed = t.products.select(
        F.col("id").alias("product_id"), F.col("quantity").alias("stock"), F.col("discounted_price").alias("offer")
    )
    lines = t.cart.join(listed, "product_id")
    stock = listed.select("product_id", "stock")
    asked = t.cart.join(listed, "product_id", "left_semi").select("user_id", "product_id", "quantity")
    turns = sorted_positions(
        asked.select("user_id").distinct(), [], [F.md5(F.col("user_id").cast("string")), F.col("user_id")], "unit"
    )
    served = ration(asked.join(turns, "user_id").drop("user_id"), stock).join(turns, "unit").select("user_id", "served")
    verdicts = served.select("user_id", F.when(~F.col("served"), "Insufficient stock").alias("reason"))
    through = served.filter(F.col("served")).select("user_id")
    # An offer of zero does not count as one.
    final = F.when(F.col("offer") != 0, F.col("offer")).otherwise(F.col("price"))
    bought = lines.join(through, "user_id", "left_semi").select(
        "user_id",
        "product_id",
        "product_name",
        final.alias("price"),
        "quantity",
        F.col("offer").alias("discounted_price"),
        (final * F.col("quantity")).cast("decimal(14,2)").alias("total_amount"),
        _moment(as_of).alias("purchase_date"),
        F.lit("Completed").alias("status"),
    )
    taken = bought.groupBy("product_id").agg(F.sum("quantity").alias("taken"))
    return Change(
        verdicts,
        {
            "new_purchases": bought,
            "products": _less_stock(t.products, taken),
            "cart": t.cart.join(through, "user_id", "left_anti"),
        },
    )


def decrement_stock(t: Tables, requests: DataFrame) -> Change:
    """Stock withdrawals in request order; one that exceeds what is left is turned down."""
    stock = t.products.select(F.col("id").alias("product_id"), F.col("quantity").alias("stock"))
    lines = requests.select(F.col("request_id").alias("unit"), "product_id", "quantity")
    served = ration(lines, stock).select(F.col("unit").alias("request_id"), "served")
    verdicts = (
        requests.join(served, "request_id", "left")
        .withColumn("reason", F.when(~F.col("served"), REFUSED))
        .drop("served")
    )
    taken = (
        verdicts.filter(F.col("reason").isNull()).groupBy("product_id").agg(F.sum("quantity").alias("taken"))
    )
    return Change(verdicts, {"products": _less_stock(t.products, taken)})


# Feedback and donations


def record_drive_feedback(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """Feedback on drives: every field is required, repeats are allowed."""
    missing = _any_blank("event_id", "rating", "feedback_text")
    verdicts = requests.withColumn("reason", first_failure((missing, "Missing required fields")))
    new = verdicts.filter(F.col("reason").isNull()).withColumn("submission_date", _moment(as_of))
    return Change(verdicts, {"drive_feedback": _appended(t.drive_feedback, new)})


def record_product_feedback(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """Feedback on purchases: a rating from one to five, once per purchase."""
    invalid = (
        _any_blank("purchase_id", "rating", "product_id")
        | ~F.col("rating").between(1, 5)
        | (F.col("purchase_id") == 0)
        | (F.col("product_id") == 0)
    )
    given = t.product_feedback.select(F.col("purchase_history_id").alias("purchase_id"))
    rows = flag_existing(requests, given, ["purchase_id"], "given")
    rows = with_winner(rows, ["purchase_id"], ~invalid & ~F.col("given"))
    reason = first_failure(
        (invalid, "Invalid data"),
        (F.col("given") | (F.col("winner") < F.col("request_id")), "Feedback already submitted"),
    )
    verdicts = rows.withColumn("reason", reason).drop("given", "winner")
    new = (
        numbered_after(verdicts.filter(F.col("reason").isNull()), "request_id", t.product_feedback)
        .withColumnRenamed("purchase_id", "purchase_history_id")
        .withColumn("created_at", _moment(as_of))
    )
    return Change(verdicts, {"product_feedback": _appended(t.product_feedback, new)})


def record_donations(t: Tables, requests: DataFrame, as_of: str = AS_OF) -> Change:
    """Donations: donor fields first, then an organiser."""
    verdicts = requests.withColumn(
        "reason",
        first_failure(
            (_any_blank("donor_name", "donor_email", "donor_phone", "amount"), "All fields are required."),
            (F.col("organiser_id").isNull(), "No organiser selected."),
        ),
    )
    new = numbered_after(verdicts.filter(F.col("reason").isNull()), "request_id", t.donations).withColumns(
        {"donation_date": _moment(as_of), "status": F.lit("Pending")}
    )
    rows = _appended(t.donations.limit(0), new)
    return Change(verdicts, {"donations": t.donations.unionByName(rows), "new_donations": rows})
