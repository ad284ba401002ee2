"""Hand-made datasets of a few rows: give some columns, the rest is filled in."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tidecrew.sources.catalog import Tables

SCHEMAS = {
    "users": "id long, username string, email string, mobile string, location string, role string, created_at timestamp_ntz",
    "drives": (
        "id long, organiser_id long, event_name string, event_date date, event_time string, num_volunteers long, "
        "salary_per_volunteer decimal(10,2), latitude double, longitude double, photo_path string, supplies string, "
        "status string, products_recycled long, created_at timestamp_ntz, plastics_collected double"
    ),
    "drive_volunteers": (
        "event_id long, volunteer_id long, joined_date timestamp_ntz, plastics_collected double, hours_worked long, "
        "payment_status string"
    ),
    "drive_feedback": (
        "event_id long, volunteer_id long, rating int, feedback_text string, submission_date timestamp_ntz"
    ),
    "volunteer_badges": "id long, volunteer_id long, event_id long, badge_type string, awarded_date timestamp_ntz",
    "donations": (
        "id long, donor_name string, donor_email string, donor_phone string, amount decimal(10,2), organiser_id long, "
        "donation_date timestamp_ntz, status string"
    ),
    "products": (
        "id long, name string, description string, price decimal(10,2), discounted_price decimal(10,2), "
        "category string, units string, quantity long, status string, organiser_id long, image_path string, "
        "created_at date, popularity_score long"
    ),
    "purchases": (
        "id long, user_id long, product_id long, product_name string, price decimal(10,2), "
        "discounted_price decimal(10,2), quantity long, total_amount decimal(14,2), purchase_date timestamp_ntz, "
        "status string"
    ),
    "product_feedback": (
        "id long, purchase_history_id long, user_id long, product_id long, rating int, comment string, "
        "created_at timestamp_ntz"
    ),
    "cart": (
        "user_id long, product_id long, product_name string, quantity long, price decimal(10,2), "
        "discounted_price decimal(10,2)"
    ),
    "places": "latitude double, longitude double, display_name string",
}
DEFAULTS = {
    "drives": {
        "event_name": "drive",
        "event_date": date(2001, 7, 1),
        "status": "Completed",
        "organiser_id": 1,
        "num_volunteers": 3,
        "salary_per_volunteer": Decimal("10"),
    },
    "products": {
        "name": "thing",
        "description": "text",
        "price": Decimal("10.00"),
        "category": "recycled",
        "quantity": 20,
        "status": "Approved",
        "organiser_id": 1,
        "created_at": date(2000, 1, 1),
        "popularity_score": 0,
    },
    "purchases": {
        "product_name": "thing",
        "price": Decimal("10.00"),
        "quantity": 1,
        "total_amount": Decimal("10.00"),
        "purchase_date": datetime(2001, 7, 1),
        "status": "Completed",
    },
    "users": {"role": "buyer", "created_at": datetime(2001, 1, 1)},
    "drive_volunteers": {"joined_date": datetime(2001, 6, 1)},
    "product_feedback": {"created_at": datetime(2001, 7, 2)},
    "donations": {"donation_date": datetime(2001, 7, 2), "amount": Decimal("5.00"), "donor_name": "d"},
    "volunteer_badges": {"awarded_date": datetime(2001, 6, 2)},
    "cart": {"product_name": "thing", "quantity": 1, "price": Decimal("10.00")},
}


def micro_tables(spark, **given: list[dict]) -> Tables:
    def build(name):
        fields = [f.split()[0] for f in SCHEMAS[name].replace("(10,2)", "").replace("(14,2)", "").split(", ")]
        rows = [{**DEFAULTS.get(name, {}), **row} for row in given.get(name, [])]
        return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name])

    return Tables(spark, {name: (lambda name=name: build(name)) for name in SCHEMAS})


def values(df, *columns: str) -> list[tuple]:
    """Collected rows of the given columns."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
