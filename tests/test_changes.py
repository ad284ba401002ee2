"""Change jobs: verdicts, conservation of stock, and rationing against one-after-the-other processing."""

import hashlib
import random
from decimal import Decimal

import pytest
from micro import micro_tables, values
from pyspark.sql import functions as F

from tidecrew.plans.keyed import upsert_by_key
from tidecrew.operators import changes
from tidecrew.plans import rationing
from tidecrew.plans.rationing import ration
from tidecrew.sources.requests import request_batch


def one_after_the_other(lines, stock):
    """The plain sequential outcome."""
    left, served = dict(stock), {}
    for unit in sorted({u for u, _, _ in lines}):
        mine = [(p, q) for u, p, q in lines if u == unit]
        served[unit] = all(left.get(p) is not None and q <= left[p] for p, q in mine)
        if served[unit]:
            for p, q in mine:
                left[p] -= q
    return served


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rationing_equals_sequential_service(spark, seed):
    rnd = random.Random(seed)
    stock = [(p, None if p == 5 else rnd.randrange(40)) for p in range(6)]
    lines = []
    for unit in range(60):
        # Product 0 is in about half of all carts.
        products = {0 if rnd.random() < 0.5 else rnd.randrange(7) for _ in range(rnd.randrange(1, 4))}
        lines += [(unit, p, rnd.randrange(1, 9)) for p in products]
    got = ration(
        spark.createDataFrame(lines, "unit long, product_id long, quantity long"),
        spark.createDataFrame(stock, "product_id long, stock long"),
    )
    assert {r.unit: r.served for r in got.collect()} == one_after_the_other(lines, stock)


def test_a_long_chain_of_carts_takes_few_rounds(spark, monkeypatch):
    """Cart i shares a product with cart i + 1, and there is one piece of each."""
    rounds = []
    totals = rationing.running_totals
    monkeypatch.setattr(rationing, "running_totals", lambda *a, **k: rounds.append(1) or totals(*a, **k))
    carts = 200
    t = micro_tables(
        spark,
        products=[{"id": p, "quantity": 1} for p in range(carts + 1)],
        cart=[{"user_id": u, "product_id": p, "quantity": 1} for u in range(carts) for p in (u, u + 1)],
    )
    got = {r.user_id: r.reason is None for r in changes.checkout_carts(t).verdicts.collect()}
    order = sorted(range(carts), key=lambda u: hashlib.md5(str(u).encode()).hexdigest())
    lines = [(turn, p, 1) for turn, u in enumerate(order) for p in (u, u + 1)]
    want = one_after_the_other(lines, [(p, 1) for p in range(carts + 1)])
    assert got == {u: want[turn] for turn, u in enumerate(order)}
    assert len(rounds) <= 20


def total_stock(df):
    return df.agg(F.sum("quantity")).first()[0]


def test_stock_is_conserved(spark, small):
    change = changes.decrement_stock(small, request_batch(small, "stock_requests"))
    sold = change.accepted.agg(F.sum("quantity")).first()[0]
    assert total_stock(small.products) == total_stock(change.tables["products"]) + sold
    assert change.accepted.count() + change.rejected.count() == request_batch(small, "stock_requests").count()
    checkout = changes.checkout_carts(small)
    bought = checkout.tables["new_purchases"].agg(F.sum("quantity")).first()[0]
    assert total_stock(small.products) == total_stock(checkout.tables["products"]) + bought
    assert checkout.tables["products"].filter("quantity < 0").isEmpty()
    direct = changes.apply_purchases(small, request_batch(small, "purchase_requests"))
    assert total_stock(small.products) == total_stock(direct.tables["products"]) + total_stock(direct.accepted)


def test_strict_purchases_stay_within_the_stock(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1}],
        products=[{"id": 1, "quantity": 5, "price": Decimal("2.00")}],
        cart=[{"user_id": 1, "product_id": 1}],
    )
    asked = spark.createDataFrame(
        [(1, 1, 1, 4, False), (2, 1, 1, 2, False), (3, 1, 1, 1, True), (4, 1, 8, 1, False)],
        "request_id long, user_id long, product_id long, quantity long, from_cart boolean",
    )
    loose = changes.apply_purchases(t, asked)
    assert values(loose.tables["products"], "quantity") == [(-2,)]
    strict = changes.apply_purchases(t, asked, strict=True)
    assert sorted(values(strict.verdicts, "request_id", "reason")) == [
        (1, None),
        (2, "Insufficient stock"),
        (3, None),
        (4, "Product not found"),
    ]
    assert values(strict.tables["products"], "quantity") == [(0,)]
    assert strict.tables["cart"].isEmpty()
    assert sorted(values(strict.tables["purchases"], "id", "total_amount")) == [(1, Decimal("8.00")), (2, Decimal("2.00"))]


def test_a_cart_goes_through_whole_or_not_at_all(spark):
    t = micro_tables(
        spark,
        products=[{"id": 1, "quantity": 3}, {"id": 2, "quantity": 1, "discounted_price": Decimal("4.00")}],
        cart=[
            {"user_id": 1, "product_id": 1, "quantity": 2},
            {"user_id": 1, "product_id": 2, "quantity": 2},
            {"user_id": 2, "product_id": 1, "quantity": 3},
            {"user_id": 3, "product_id": 2, "quantity": 1},
        ],
    )
    change = changes.checkout_carts(t)
    assert sorted(values(change.verdicts)) == [(1, "Insufficient stock"), (2, None), (3, None)]
    assert sorted(values(change.tables["products"], "id", "quantity")) == [(1, 0), (2, 0)]
    assert {r.user_id for r in change.tables["cart"].collect()} == {1}
    prices = sorted(values(change.tables["new_purchases"], "user_id", "price", "discounted_price"))
    assert prices == [(2, Decimal("10.00"), None), (3, Decimal("4.00"), Decimal("4.00"))]


def test_cart_lines_grow_up_to_the_stock(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "role": "volunteer"}],
        products=[
            {"id": 1, "quantity": 3, "discounted_price": Decimal("9.00")},
            {"id": 2, "quantity": 0},
            {"id": 3, "quantity": 2, "name": "new"},
        ],
        cart=[{"user_id": 1, "product_id": 3, "quantity": 2, "product_name": "old"}],
    )
    asked = spark.createDataFrame(
        [(i, 1, p) for i, p in enumerate((1, 1, 1, 1, 2, 3, 4))], "request_id long, user_id long, product_id long"
    )
    change = changes.add_to_cart(t, asked)
    assert sorted(values(change.verdicts, "product_id", "added", "reason")) == [
        (1, 3, "Requested quantity exceeds available stock"),
        (2, 0, "Product is out of stock"),
        (3, 0, "Requested quantity exceeds available stock"),
        (4, 0, "Product not found"),
    ]
    assert sorted(values(change.tables["cart"], "product_id", "quantity", "product_name", "discounted_price")) == [
        (1, 3, "thing", Decimal("9.00")),
        (3, 2, "old", None),
    ]


def test_the_first_of_equal_requests_wins(spark):
    t = micro_tables(spark, users=[{"id": 7, "email": "a@x"}])
    columns = "request_id long, username string, email string, mobile string, location string, role string"
    asked = spark.createDataFrame(
        [
            (1, "u", "a@x", "1", "l", "buyer"),
            (2, "", "b@x", "1", "l", "buyer"),
            (3, "u", "b@x", "1", "l", "buyer"),
            (4, "u", "b@x", "1", "l", "buyer"),
        ],
        columns,
    )
    change = changes.register_users(t, asked)
    assert sorted(values(change.verdicts, "request_id", "reason")) == [
        (1, "Email already exists."),
        (2, "All fields are required."),
        (3, None),
        (4, "Email already exists."),
    ]
    assert sorted(values(change.tables["users"], "id", "email")) == [(7, "a@x"), (8, "b@x")]


def test_the_later_of_two_updates_stays(spark):
    t = micro_tables(spark, products=[{"id": 1, "quantity": 9}], cart=[{"user_id": 1, "product_id": 1}])
    asked = spark.createDataFrame(
        [(1, 1, 1, 4), (2, 1, 1, 6), (3, 1, 1, 10), (4, 1, 1, 0)],
        "request_id long, user_id long, product_id long, quantity long",
    )
    change = changes.set_cart_quantity(t, asked)
    assert values(change.tables["cart"], "quantity") == [(6,)]
    assert change.rejected.count() == 2


def test_deletions_reach_the_children(spark):
    t = micro_tables(
        spark,
        drives=[{"id": 1, "organiser_id": 1}, {"id": 2, "organiser_id": 2}],
        drive_volunteers=[{"event_id": i, "volunteer_id": 5} for i in (1, 2)],
        volunteer_badges=[{"event_id": i, "volunteer_id": 5} for i in (1, 2)],
        drive_feedback=[{"event_id": i, "volunteer_id": 5} for i in (1, 2)],
    )
    asked = spark.createDataFrame([(1, 1), (2, 1)], "event_id long, organiser_id long")
    owned = changes.delete_drives(t, asked)
    assert {n: df.count() for n, df in owned.items()} == dict.fromkeys(owned, 1)
    loose = changes.delete_drives(t, asked, check_owner_first=False)
    assert loose["drives"].count() == 1 and loose["drive_volunteers"].isEmpty()
    admin = changes.delete_drives(t, asked, admin=True)
    assert admin["drives"].isEmpty() and admin["volunteer_badges"].count() == 2


def test_single_work_updates(spark):
    t = micro_tables(spark, drive_volunteers=[{"event_id": 1, "volunteer_id": 2}, {"event_id": 1, "volunteer_id": 3}])
    batch = spark.createDataFrame([(1, 2, 7.5, 3)], "event_id long, volunteer_id long, plastics_collected double, hours_worked long")
    assert sorted(values(changes.record_plastics(t, batch), "volunteer_id", "plastics_collected")) == [(2, 7.5), (3, None)]
    assert sorted(values(changes.record_hours(t, batch), "volunteer_id", "hours_worked")) == [(2, 3), (3, None)]
    assert sorted(values(changes.mark_paid(t, batch), "volunteer_id", "payment_status")) == [(2, "Paid"), (3, None)]


def test_uploads_name_the_first_failing_rule(spark):
    t = micro_tables(
        spark,
        products=[{"id": 3, "name": "net"}, {"id": 4, "name": "gone", "status": "Deleted"}],
    )
    good = ("net2", "Recycled ", "2.5", "12.7", "d", "a.png")
    rows = [
        (1, "", *good[1:]),
        (2, "net", "other", *good[2:]),
        (3, "gone", *good[1:]),
        (4, "a", "recycled", "abc", *good[3:]),
        (5, "a", "recycled", "1", "0.9", *good[4:]),
        (6, "a", "paper", *good[2:]),
        (7, "a", *good[1:5], "a.exe"),
        (8, *good),
        (9, "net2", "recycled", "-1", *good[3:]),
    ]
    df = spark.createDataFrame(
        [(r[0], 1, *r[1:]) for r in rows],
        "request_id long, organiser_id long, name string, product_type string, price string, quantity string, "
        "description string, file_name string",
    )
    change = changes.upload_products(t, df)
    taken = "A product with this name already exists in your inventory"
    assert dict(values(change.verdicts, "request_id", "reason")) == {
        1: "Product name is required",
        2: taken,
        3: None,
        4: "Invalid price format. Please enter a valid number.",
        5: "Quantity must be greater than 0",
        6: "Invalid product type: paper. Must be wholesale or recycled.",
        7: "Invalid image format",
        8: None,
        9: taken,
    }
    new = change.tables["products"].filter("id > 4")
    assert sorted(values(new, "id", "name", "quantity", "units", "status")) == [
        (5, "gone", 12, "units", "Pending"),
        (6, "net2", 12, "units", "Pending"),
    ]


def test_of_repeated_requests_the_last_accepted_one_counts(spark):
    t = micro_tables(
        spark,
        users=[{"id": 1, "username": "a"}],
        drives=[{"id": 1, "organiser_id": 5, "event_name": "x", "products_recycled": 1}],
        products=[{"id": 1, "status": "Pending"}],
    )
    batch = spark.createDataFrame(
        [(i, 1, f"n{i}", "e", "m", "l", "r") for i in (1, 3, 2)],
        "request_id long, id long, username string, email string, mobile string, location string, role string",
    )
    assert values(changes.update_users(t, batch), "id", "username") == [(1, "n3")]
    reviews = spark.createDataFrame([(1, 1, "Approved"), (2, 1, "Rejected")], "request_id long, id long, status string")
    assert values(changes.review_products(t, reviews), "id", "status") == [(1, "Rejected")]
    made = spark.createDataFrame(
        [(1, 1, 5, 10), (2, 1, 5, 20), (3, 1, None, 30), (4, 1, 6, 40)],
        "request_id long, event_id long, organiser_id long, products_recycled long",
    )
    change = changes.record_products(t, made)
    assert values(change.tables["drives"], "id", "products_recycled") == [(1, 20)]
    assert sorted(r.request_id for r in change.rejected.collect()) == [3, 4]


def test_a_drive_without_named_organiser_is_not_renamed(spark):
    t = micro_tables(spark, drives=[{"id": 1, "organiser_id": 5, "event_name": "x"}])
    batch = spark.createDataFrame(
        [(1, 1, None, "y")], "request_id long, id long, organiser_id long, event_name string"
    ).selectExpr(
        "*",
        "date'2001-01-01' as event_date",
        "'10' as event_time",
        "1 as num_volunteers",
        "cast(1 as decimal(10,2)) as salary_per_volunteer",
        "'Active' as status",
    )
    assert values(changes.update_drives(t, batch).tables["drives"], "id", "event_name") == [(1, "x")]


def test_upsert_keeps_a_row_per_key(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(2, "x"), (2, "z"), (3, "y")], "k long, v string")
    assert sorted(values(upsert_by_key(current, batch, ["k"]))) == [(1, "a"), (2, "z"), (3, "y")]
