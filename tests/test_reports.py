"""The reports' special cases on tables of a few rows."""

from datetime import date, datetime
from decimal import Decimal

from micro import micro_tables, values

from tidecrew.functions import pricing, text
from tidecrew.operators import impact, marketplace, organisers


def test_bare_end_date_leaves_out_that_day(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "o"}],
        donations=[
            {"id": 1, "donation_date": datetime(2001, 7, 9, 23), "organiser_id": 1},
            {"id": 2, "donation_date": datetime(2001, 7, 10)},
            {"id": 3, "donation_date": datetime(2001, 7, 10, 1)},
        ],
    )
    assert values(impact.donations_filtered(t, end="2001-07-10"), "id") == [(2,), (1,)]
    assert values(impact.donations_filtered(t, end="2001-07-10", inclusive_end=True), "id") == [(3,), (2,), (1,)]
    assert values(impact.donations_filtered(t, organiser="o"), "id", "organiser_name") == [(1, "o")]
    assert values(impact.donations_total(impact.donations_filtered(t, organiser="nobody"))) == [(Decimal(0),)]


def test_equal_product_figures_count_once_in_the_original_column(spark):
    t = micro_tables(
        spark,
        drives=[{"id": i, "products_recycled": p} for i, p in enumerate((7, 7, 5, None))],
        drive_volunteers=[{"event_id": 0, "volunteer_id": v, "plastics_collected": 1.5} for v in (1, 2)],
    )
    assert values(impact.monthly_stats(t)) == [("2001-07", 4, 3.0, 12, 19)]


def test_products_are_multiplied_by_volunteers_unless_fixed(spark):
    t = micro_tables(
        spark,
        drives=[{"id": 1, "products_recycled": 4}, {"id": 2, "products_recycled": 3}],
        drive_volunteers=[
            {"event_id": 1, "volunteer_id": 1, "hours_worked": 2, "payment_status": "Paid"},
            {"event_id": 1, "volunteer_id": 2, "hours_worked": 5},
        ],
    )
    assert values(organisers.organiser_completed_totals(t), "total_products", "total_payments") == [(11, Decimal("20"))]
    assert values(organisers.organiser_completed_totals(t, fixed=True), "total_products") == [(7,)]


def test_missing_status_follows_from_the_date(spark):
    days = [date(2001, 7, 14), date(2001, 7, 15), date(2001, 7, 16)]
    t = micro_tables(spark, drives=[{"id": i, "event_date": d, "status": None} for i, d in enumerate(days)])
    rows = sorted(values(organisers.organiser_drives(t), "id", "status"))
    assert rows == [(0, "Completed"), (1, "Active"), (2, "Upcoming")]


def test_one_volunteers_joinable_drives(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "o"}],
        drives=[{"id": i, "event_date": date(2001, 8, i), "latitude": 1.0, "longitude": 2.0} for i in (1, 2)],
        drive_volunteers=[{"event_id": 2, "volunteer_id": 9}],
        places=[{"latitude": 1.00001, "longitude": 2.0, "display_name": "Beach"}],
    )
    rows = values(organisers.joinable_drives_for(t, 9), "id", "is_joined", "joined_volunteers", "location")
    assert rows == [(1, False, 0, "Beach"), (2, True, 1, "Beach")]


def test_flags_of_a_cohort_over_several_bitmaps(spark):
    joined = [9, 16, 32_777, 32_778, 39_999, 70_000]
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "o"}],
        drives=[{"id": i, "event_date": date(2001, 8, i)} for i in (1, 2)] + [{"id": 3, "event_date": date(2001, 6, 1)}, {"id": 4, "organiser_id": 5, "event_date": date(2001, 8, 1)}],
        drive_volunteers=[{"event_id": e, "volunteer_id": v} for e in (2, 3, 4) for v in joined],
    )
    cohort = spark.range(8, 40_000).toDF("volunteer_id")
    rows = organisers.joinable_flags(t, cohort)
    assert rows.count() == 2 * 39_992
    assert sorted(values(rows.filter("is_joined"), "id", "volunteer_id")) == [(2, v) for v in joined if v < 40_000]
    assert organisers.joinable_flags(t, cohort.limit(0)).count() == 0


def test_volunteer_names_have_a_numbered_row_each(spark):
    people = [{"id": i, "username": f"v{i:04d}"} for i in range(5000)]
    t = micro_tables(
        spark,
        users=people,
        drives=[{"id": 1}, {"id": 2}],
        drive_volunteers=[{"event_id": 1, "volunteer_id": i} for i in range(5000)],
    )
    rows = values(organisers.drive_volunteer_names(t), "id", "position", "volunteer_name")
    assert (2, None, None) in rows and len(rows) == 5001
    assert {(p, n) for i, p, n in rows if i == 1} == {(i + 1, f"v{i:04d}") for i in range(5000)}
    (text,) = values(organisers.volunteer_name_list(t, 1), "volunteer_names")
    assert text[0].split(",") == [p["username"] for p in people]


def test_badge_case_does_not_matter_and_unknown_badges_give_nothing(spark):
    t = micro_tables(
        spark,
        users=[{"id": i, "role": "volunteer"} for i in (1, 2)] + [{"id": 3, "role": "buyer"}],
        volunteer_badges=[
            {"volunteer_id": 1, "badge_type": "gold"},
            {"volunteer_id": 1, "badge_type": "DIAMOND"},
            {"volunteer_id": 2, "badge_type": "wooden"},
            {"volunteer_id": 3, "badge_type": "gold"},
        ],
        products=[{"id": 5, "price": Decimal("9.99")}],
    )
    assert sorted(values(pricing.highest_badge(t), "volunteer_id", "highest_badge")) == [
        (1, "diamond"),
        (2, "wooden"),
        (3, "gold"),
    ]
    assert sorted(values(marketplace.volunteer_discount(t), "user_id", "discount_pct")) == [(1, 20), (2, 0), (3, 0)]
    t = t.with_tables(users=t.users.union(spark.createDataFrame([(1, "o", *[None] * 4, None)], t.users.schema)))
    assert values(marketplace.priced_catalog_for(t, 1), "discounted_price")[0] == (Decimal("7.99"),)


def test_search_without_term_is_the_catalogue(spark, small):
    found = sorted(values(marketplace.product_search(small, ""), "id"))
    assert found == sorted(values(marketplace.approved_catalog(small), "id"))


def test_search_ties_go_to_the_higher_id_and_need_a_description(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "o"}],
        products=[{"id": i, "name": "Net 50%"} for i in range(1, 8)] + [{"id": 9, "name": "net", "description": None}],
    )
    assert len(values(marketplace.product_search(t, "NET"))) == 8
    assert values(marketplace.search_recommendations(t, "net"), "id", "score") == [(i, 6) for i in (7, 6, 5, 4, 3)]
    assert 9 in [r[0] for r in values(marketplace.search_recommendations(t), "id")]
    # Wildcards in the term are live in the search.
    assert len(values(marketplace.product_search(t, "n_t"))) == 8


def test_text_functions(spark):
    from pyspark.sql import functions as F

    rows = [
        ("8.5, 76.25", " /static/uploads/a.JPG ", '{"address": {"road": "R", "town": "T", "postcode": "6"}}'),
        ("8.5,x", "//b.exe", '{"error": "none"}'),
        ("new_delhi-east", None, "not json"),
        (None, "c", None),
    ]
    df = spark.createDataFrame(rows, "place string, path string, answer string").select(
        text.latitude(F.col("place")),
        text.title_location(F.col("place")),
        text.clean_path(F.col("path")),
        text.image_extension_ok(F.col("path")),
        text.format_address(F.col("answer")),
    )
    assert values(df) == [
        (8.5, "8.5, 76.25", "uploads/a.JPG", False, "R\nT\nPIN: 6"),
        (None, "8.5,x", "b.exe", False, text.NO_ADDRESS),
        (None, "New Delhi East", None, False, text.NO_ADDRESS),
        (None, text.NO_LOCATION, "c", False, text.NO_ADDRESS),
    ]


def test_flags_of_a_cohort_are_not_shuffled(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "o"}],
        drives=[{"id": 1, "organiser_id": 1, "event_date": date(2001, 8, 1)}],
        drive_volunteers=[{"event_id": 1, "volunteer_id": 5}],
    )
    rows = organisers.joinable_flags(t, spark.range(4, 7).toDF("volunteer_id"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "Exchange" not in plan.split("posexplode")[0]
    assert sorted(values(rows, "volunteer_id", "is_joined")) == [(4, False), (5, True), (6, False)]


def test_flags_come_volunteer_by_volunteer_within_a_block_of_drives(spark, monkeypatch):
    """Pages came drive by drive, each with all volunteers, so a file of them held that long list anew for every drive."""
    monkeypatch.setattr(organisers, "SPAN", 70)
    ids = [*range(100, 300), 150, 150, None]
    t = micro_tables(
        spark,
        users=[{"id": 1, "role": "organiser"}],
        drives=[{"id": i, "organiser_id": 1, "event_date": date(2001, 8, 1)} for i in ids],
        drive_volunteers=[{"event_id": e, "volunteer_id": v} for e, v in [(100, 7), (163, 7), (164, 7), (150, 9), (150, 9), (None, 9), (299, 20_000), (5, 7)]],
    )
    people = [*range(40), 20_000]
    cohort = spark.createDataFrame([(p,) for p in [*people, 7, None]], "volunteer_id long")
    parts = organisers.joinable_flags(t, cohort).rdd.map(tuple).glom().collect()
    rows = [row for part in parts for row in part]
    expected = {(7, 100), (7, 163), (7, 164), (9, 150), (20_000, 299)}
    assert sorted(rows, key=str) == sorted(((p, i, (p, i) in expected) for p in people for i in ids), key=str)
    for part in parts:
        # A new run of a volunteer for each block only, whatever the number of drives.
        assert sum(a[0] != b[0] for a, b in zip(part, part[1:], strict=False)) <= 3 * len(people)
