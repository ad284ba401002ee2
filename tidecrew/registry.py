"""Every report and job by name, as a function of the domain datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.functions import pricing
from tidecrew.operators import changes, closest, impact, marketplace, nearest, organisers, recommend, searching, similar, training
from tidecrew.operators.boosted import Settings
from tidecrew.oracle import changes as changes_sql
from tidecrew.oracle import flows as flows_sql
from tidecrew.oracle import impact as impact_sql
from tidecrew.oracle import marketplace as marketplace_sql
from tidecrew.oracle import organisers as organisers_sql
from tidecrew.oracle import recommend as recommend_sql
from tidecrew.plans.durable import cut, kept, new_folder
from tidecrew.plans.keyed import upsert_by_key
from tidecrew.plans.parts import store_parts
from tidecrew.session import tune
from tidecrew.sources.catalog import TABLE_NAMES, Tables, row_counts, store_bucketed
from tidecrew.sources.mapping import benchmark_tables
from tidecrew.sources.requests import request_batch, request_stream
from tidecrew.sources.sinks import append_rows, appended_rows, export_json, plain_types
from tidecrew.streaming import jobs

IMPACT: dict[str, Callable[[Tables], DataFrame]] = {
    "impact_stats": impact.impact_stats,
    "top_volunteers": impact.top_volunteers,
    "featured_products": impact.featured_products,
    "dashboard_stats": impact.dashboard_stats,
    "recent_activities": impact.recent_activities,
    "user_activity": impact.user_activity,
    "drive_overview": impact.drive_overview,
    "donations_filtered": impact.donations_filtered,
    "donations_filtered_range": lambda t: impact.donations_filtered(
        t, organiser="Supplier#000000007", start="2001-06-20", end="2001-07-10"
    ),
    "donations_total": lambda t: impact.donations_total(
        impact.donations_filtered(t, start="2001-06-20", end="2001-07-10", ordered=False)
    ),
    "organiser_names": impact.organiser_names,
    "monthly_stats": impact.monthly_stats,
    "top_organizers": impact.top_organizers,
    "completed_buyers": impact.completed_buyers,
    "donations_export": impact.donations_export,
    "month_labels": lambda t: impact.month_labels(impact.monthly_stats(t)),
    "pending_products": impact.pending_products,
}

ORGANISERS: dict[str, Callable[[Tables], DataFrame]] = {
    "organiser_drives": organisers.organiser_drives,
    "organiser_buyers": organisers.organiser_buyers,
    "organiser_donors": organisers.organiser_donors,
    "joinable_drives": organisers.joinable_drives,
    "joined_drives": organisers.joined_drives,
    "joinable_flags_cohort": lambda t: organisers.joinable_flags(
        t, t.users.filter((F.col("role") == "volunteer") & (F.col("id") % 50 == 0)).select(F.col("id").alias("volunteer_id"))
    ),
    "drive_capacity": organisers.drive_capacity,
    "supplies_list": organisers.supplies_list,
    "supplies_text": lambda t: organisers.supplies_text(organisers.supplies_list(t)),
    "badge_history": organisers.badge_history,
    "badge_counts": organisers.badge_counts,
    "drive_roster": organisers.drive_roster,
    "organiser_completed_totals": organisers.organiser_completed_totals,
    "organiser_completed_totals_fixed": lambda t: organisers.organiser_completed_totals(t, fixed=True),
    "organiser_completed_drives": organisers.organiser_completed_drives,
    "drive_payroll": organisers.drive_payroll,
    "drive_total_plastics": organisers.drive_total_plastics,
    "volunteer_history": organisers.volunteer_history,
    "drive_volunteer_names": organisers.drive_volunteer_names,
    "organiser_feedback": organisers.organiser_feedback,
    "feedback_stats": organisers.feedback_stats,
    "feedback_by_drive": organisers.feedback_by_drive,
    "feedback_by_drive_name": lambda t: organisers.feedback_by_drive(t, by_name=True),
    "organiser_directory": organisers.organiser_directory,
    "organiser_directory_fixed": lambda t: organisers.organiser_directory(t, fixed=True),
    "organiser_directory_any_status": organisers.organiser_directory_any_status,
    "organiser_products": organisers.organiser_products,
    "user_locations": organisers.user_locations,
    "nearest_places": lambda t: nearest.nearest_places(request_batch(t, "reported_points"), request_batch(t, "collection_points")),
    "addresses": organisers.addresses,
    "donation_receipt": organisers.donation_receipt,
    "public_drives": organisers.public_drives,
    "buyer_summary": organisers.buyer_summary,
    "buyer_products": organisers.buyer_products,
}

MARKETPLACE: dict[str, Callable[[Tables], DataFrame]] = {
    "approved_catalog": marketplace.approved_catalog,
    "approved_catalog_slim": marketplace.approved_catalog_slim,
    "highest_badge": pricing.highest_badge,
    "volunteer_discount": marketplace.volunteer_discount,
    "priced_catalog": marketplace.priced_catalog,
    "priced_catalog_search": lambda t: marketplace.priced_catalog(t, null_without_discount=True),
    "cart_contents": marketplace.cart_contents,
    "cart_count": marketplace.cart_count,
    "cart_total": marketplace.cart_total,
    "cart_total_badge": marketplace.cart_total_badge,
    "purchase_history_view": marketplace.purchase_history_view,
    "purchase_totals": lambda t: marketplace.purchase_totals(marketplace.purchase_history_view(t)),
    "purchase_filter_all": marketplace.purchase_filter,
    "purchase_filter_completed": lambda t: marketplace.purchase_filter(t, "Completed"),
    "purchase_filter_pending": lambda t: marketplace.purchase_filter(t, "pending"),
    "product_rating_summary": marketplace.product_rating_summary,
    "product_rating": marketplace.product_rating,
    "latest_feedback": marketplace.latest_feedback,
    "product_search": marketplace.product_search,
    "product_search_term": lambda t: marketplace.product_search(t, " Bolt "),
    "product_search_wildcards": lambda t: marketplace.product_search(t, "b_lt%"),
    "product_search_backslash": lambda t: marketplace.product_search(t, "bolt\\"),
    "search_table": lambda t: searching.term_matches(t, request_batch(t, "search_terms")).select("term", "id", "name", "purchase_count"),
    "search_table_recommendations": lambda t: searching.term_recommendations(t, request_batch(t, "search_terms")),
    "search_recommendations": marketplace.search_recommendations,
    "search_recommendations_term": lambda t: marketplace.search_recommendations(t, "bolt"),
}


def _settled(t: Tables, rated: bool = False) -> Tables:
    """Purchases and ratings, and with ``rated`` the training set, stored once for the jobs that read them again and again.

    Over the benchmark tables all are joins; a stored catalogue has the first two as tables and needs no such step.
    """
    t = t.with_tables(purchases=kept(t.purchases, "purchases"))
    t = t.with_tables(product_feedback=kept(t.product_feedback, "feedback"))
    return t.with_tables(**{training.STORED_SET: cut(training.training_set(t))}) if rated else t


def _one_band(t: Tables) -> DataFrame:
    """Users of the training set; the mean score is the same for all of them."""
    return training.training_set(t).select("user_id").distinct().withColumn("user_band", F.lit(0).cast("bigint"))


def _personal_users(t: Tables) -> DataFrame:
    kinds = recommend.recommendation_type(recommend.candidate_counts(t)).filter(F.col("type") == "personalized")
    return _one_band(t).join(kinds.select("user_id"), "user_id", "left_semi")


def _model_frame(t: Tables) -> DataFrame:
    """The model's rows, stored once: the classes, the edges of the bins and the training read them."""
    return kept(training.model_frame(t), "model_frame")


def _model_recommendations(t: Tables) -> DataFrame:
    t = _settled(t, rated=True)
    model = training.rating_model(_model_frame(t))
    scores = training.model_scores(t, model, training.stored_ratings(training.model_metadata(t)))
    return recommend.recommendations(t, training.user_bands(t), scores)


def _top_recommendations(t: Tables) -> DataFrame:
    t = _settled(t, rated=True)
    return recommend.top_recommendations(t, _personal_users(t), training.mean_scores(t))


def _recommendations(t: Tables) -> DataFrame:
    t = _settled(t, rated=True)
    return recommend.recommendations(t, _one_band(t), training.mean_scores(t))


def _model_losses(t: Tables) -> DataFrame:
    frame = _model_frame(_settled(t, rated=True))
    return training.model_losses(training.rating_model(frame), frame)


def _cohort(t: Tables) -> DataFrame:
    """Every user whose id is divisible by 50, buyer or not."""
    return t.users.filter(F.col("id") % 50 == 0).select(F.col("id").alias("user_id"))


def _bought(t: Tables) -> Tables:
    """Who bought what, stored once, for jobs that read nothing else."""
    return t.with_tables(purchases=kept(t.purchases.select("user_id", "product_id"), "purchases"))


def _offers_for_all(t: Tables) -> DataFrame:
    t = _bought(t)
    everybody = t.users.select(F.col("id").alias("user_id"))
    return similar.cf_recommendations_of(t, everybody, alike=closest.similar_users_of_all(t))


def _stored_importance(t: Tables) -> DataFrame:
    """Train, store, load, and report the loaded model's importances."""
    t = _settled(t, rated=True)
    folder = new_folder(t.spark, "model")
    training.save_model(training.rating_model(_model_frame(t)), training.model_metadata(t), folder)
    model, _ = training.load_model(t.spark, folder)
    return training.feature_importance(t.spark, model)


def _model_store(t: Tables) -> DataFrame:
    """Sums over the scores of a model before and after it was stored and loaded."""
    t = _settled(t, rated=True)
    frame, folder = cut(training.model_frame(t)), new_folder(t.spark, "model")
    model = training.rating_model(frame, Settings(rounds=3))
    training.save_model(model, training.model_metadata(t), folder)
    loaded, metadata = training.load_model(t.spark, folder)
    ratings = training.stored_ratings(metadata)
    sums = training.score_sums(model, frame, ratings).unionByName(training.score_sums(loaded, frame, ratings))
    return sums.agg(F.max("ratings").alias("ratings"), F.max("shares").alias("shares"), (F.max("expected") - F.min("expected")).alias("difference"))


RECOMMENDER: dict[str, Callable[[Tables], DataFrame]] = {
    "training_set": training.training_set,
    "training_features": training.training_features,
    "active_raters": training.active_raters,
    "active_rater_check": training.active_rater_check,
    "rating_distribution": training.rating_distribution,
    "rating_index": training.rating_index,
    "label_encoding": training.label_encoding,
    "train_test_split": training.train_test_split,
    "model_metadata": training.model_metadata,
    "user_bands": training.user_bands,
    "user_bands_fine": lambda t: training.user_bands(t, 256),
    "serving_features": training.serving_features,
    "candidate_counts": recommend.candidate_counts,
    "recommendation_type": lambda t: recommend.recommendation_type(recommend.candidate_counts(t)),
    "mean_scores": training.mean_scores,
    "category_boost": recommend.category_boost,
    "top_recommendations": _top_recommendations,
    "fallback_list": recommend.fallback_list,
    "popular_list": recommend.popular_list,
    "bought_list": recommend.bought_list,
    "newest_products": recommend.newest_products,
    "recommendations": _recommendations,
    "similar_users": lambda t: similar.similar_users(t, similar.busiest_buyer(t)),
    "cf_recommendations": lambda t: similar.cf_recommendations(t, similar.busiest_buyer(t)),
    "similar_users_cohort": lambda t: similar.similar_users_of(_settled(t), _cohort(t)),
    "cf_recommendations_cohort": lambda t: similar.cf_recommendations_of(_settled(t), _cohort(t)),
    "similar_users_all": lambda t: closest.similar_users_of_all(_bought(t)),
    "cf_recommendations_all": _offers_for_all,
    "factor_recommendations": lambda t: similar.factor_recommendations(_bought(t)),
    "expected_rating": training.product_shares,
    "prior_losses": training.prior_losses,
    "root_gains": lambda t: training.root_gains(cut(training.model_frame(_settled(t, rated=True)))),
    "model_losses": _model_losses,
    "model_store": _model_store,
    "feature_importance": _stored_importance,
    "model_recommendations": _model_recommendations,
}


def _verdicts(change: Callable[..., changes.Change], batch: str) -> Callable[[Tables], DataFrame]:
    return lambda t: change(t, request_batch(t, batch)).verdicts


def _table(change: Callable[..., changes.Change], batch: str, table: str, *columns: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        new = change(t, request_batch(t, batch)).tables[table]
        return new.select(*columns) if columns else new

    return run


def _kept_drives(t: Tables, **form: bool) -> DataFrame:
    """The keys left in the drive tables after a deletion."""
    kept = changes.delete_drives(t, request_batch(t, "drive_deletions"), **form)
    rows = kept["drives"].select(F.lit("drives").alias("kept_table"), F.col("id").alias("event_id"), F.lit(0).alias("volunteer_id"))
    for name in ("drive_volunteers", "drive_feedback", "volunteer_badges"):
        rows = rows.unionByName(kept[name].select(F.lit(name).alias("kept_table"), "event_id", "volunteer_id"))
    return rows


def _kept_users(t: Tables, **form: bool) -> DataFrame:
    """The keys left in the user and purchase tables after a deletion."""
    kept = changes.delete_users(t, request_batch(t, "user_deletions"), **form)
    users = kept["users"].select(F.lit("users").alias("kept_table"), "id")
    return users.unionByName(kept["purchases"].select(F.lit("purchases").alias("kept_table"), "id"))


def _recorded_work(t: Tables) -> DataFrame:
    return changes.record_work(t, request_batch(t, "work_records"))


def _by_parts(table: str, key: str, batch: str, batch_key: str, change: Callable[[Tables, DataFrame], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A change of a table that is stored in parts, of which only those of the batch's keys are written anew."""

    def run(t: Tables) -> DataFrame:
        requests = cut(request_batch(t, batch))
        stored = store_parts(getattr(t, table), new_folder(t.spark, table), key)
        stored.change(requests.select(batch_key), lambda rows: change(t.with_tables(**{table: rows}), requests))
        return stored.read()

    return run


def _bucketed(table: str, keys: tuple[str, ...], change: Callable[..., changes.Change], batch: str) -> Callable[[Tables], DataFrame]:
    """The verdicts of a change against a table that is stored in buckets of the keys that are checked."""

    def run(t: Tables) -> DataFrame:
        folder = new_folder(t.spark, table)
        stored = store_bucketed(getattr(t, table), f"{table}_{folder[-32:]}", keys, folder, buckets=8)
        return change(t.with_tables(**{table: stored}), request_batch(t, batch)).verdicts

    return run


DRIVE_CHANGES = (
    *("id", "organiser_id", "event_name", "event_date", "event_time"),
    *("num_volunteers", "salary_per_volunteer", "status"),
)
CART_KEYS = ("user_id", "product_id", "quantity")

CHANGES: dict[str, Callable[[Tables], DataFrame]] = {
    "register_users": _verdicts(changes.register_users, "registrations"),
    "register_users_table": _table(changes.register_users, "registrations", "users"),
    "update_users": lambda t: changes.update_users(t, request_batch(t, "user_updates")),
    "upsert_by_key": lambda t: upsert_by_key(t.cart, request_batch(t, "cart_upserts"), ["user_id", "product_id"]),
    "create_drives": lambda t: changes.create_drives(t, request_batch(t, "new_drives")),
    "update_drives": lambda t: changes.update_drives(t, request_batch(t, "drive_updates")).verdicts.select(
        "request_id", "id", "organiser_id", "reason"
    ),
    "update_drives_table": _table(
        changes.update_drives,
        "drive_updates",
        "drives",
        *DRIVE_CHANGES,
    ),
    "delete_drives": _kept_drives,
    "delete_drives_any_children": lambda t: _kept_drives(t, check_owner_first=False),
    "delete_drives_admin": lambda t: _kept_drives(t, admin=True),
    "delete_users": _kept_users,
    "delete_users_buyers": lambda t: _kept_users(t, buyers_only=True),
    "delete_users_only": lambda t: _kept_users(t, cascade=False),
    "review_products": lambda t: changes.review_products(t, request_batch(t, "product_reviews")).select("id", "status"),
    "join_drives": _verdicts(changes.join_drives, "join_requests"),
    "award_badges": _verdicts(changes.award_badges, "badge_requests"),
    "record_work": _recorded_work,
    "record_work_totals": lambda t: organisers.drive_total_plastics(t.with_tables(drive_volunteers=_recorded_work(t))),
    "record_products": _verdicts(changes.record_products, "recycled_records"),
    "record_products_table": _table(changes.record_products, "recycled_records", "drives", "id", "products_recycled"),
    "upload_products": _verdicts(changes.upload_products, "uploads"),
    "apply_purchases": _verdicts(changes.apply_purchases, "purchase_requests"),
    "apply_purchases_stock": _table(changes.apply_purchases, "purchase_requests", "products", "id", "quantity"),
    "apply_purchases_cart": _table(changes.apply_purchases, "purchase_requests", "cart", *CART_KEYS),
    "add_to_cart": _verdicts(changes.add_to_cart, "cart_adds"),
    "add_to_cart_table": _table(changes.add_to_cart, "cart_adds", "cart"),
    "set_cart_quantity": _verdicts(changes.set_cart_quantity, "cart_quantities"),
    "set_cart_quantity_table": _table(changes.set_cart_quantity, "cart_quantities", "cart", *CART_KEYS),
    "remove_from_cart": lambda t: changes.remove_from_cart(t, request_batch(t, "cart_removals")).select(*CART_KEYS),
    "validate_checkout": lambda t: changes.validate_checkout(t, request_batch(t, "checkout_lines")),
    "checkout_carts": lambda t: changes.checkout_carts(t).verdicts,
    "checkout_purchases": lambda t: changes.checkout_carts(t).tables["new_purchases"],
    "checkout_stock": lambda t: changes.checkout_carts(t).tables["products"].select("id", "quantity"),
    "decrement_stock": _verdicts(changes.decrement_stock, "stock_requests"),
    "decrement_stock_table": _table(changes.decrement_stock, "stock_requests", "products", "id", "category", "quantity"),
    "update_users_parts": _by_parts("users", "id", "user_updates", "id", changes.update_users),
    "review_products_parts": lambda t: _by_parts("products", "id", "product_reviews", "id", changes.review_products)(t).select("id", "status"),
    "decrement_stock_parts": lambda t: _by_parts(
        "products", "id", "stock_requests", "product_id", lambda t, requests: changes.decrement_stock(t, requests).tables["products"]
    )(t).select("id", "category", "quantity"),
    "upsert_by_key_parts": _by_parts(
        "cart", "user_id", "cart_upserts", "user_id", lambda t, requests: upsert_by_key(t.cart, requests, ["user_id", "product_id"])
    ),
    "record_work_parts": _by_parts("drive_volunteers", "event_id", "work_records", "event_id", changes.record_work),
    "update_drives_parts": lambda t: _by_parts(
        "drives", "id", "drive_updates", "id", lambda t, requests: changes.update_drives(t, requests).tables["drives"]
    )(t).select(*DRIVE_CHANGES),
    "apply_purchases_parts": lambda t: _by_parts(
        "products", "id", "purchase_requests", "product_id", lambda t, requests: changes.apply_purchases(t, requests).tables["products"]
    )(t).select("id", "quantity"),
    "award_badges_bucketed": _bucketed("volunteer_badges", ("volunteer_id", "event_id"), changes.award_badges, "badge_requests"),
    "record_product_feedback_bucketed": _bucketed(
        "product_feedback", ("purchase_history_id",), changes.record_product_feedback, "product_feedback_requests"
    ),
    "register_users_bucketed": _bucketed("users", ("email",), changes.register_users, "registrations"),
    "join_drives_bucketed": _bucketed("drive_volunteers", ("event_id", "volunteer_id"), changes.join_drives, "join_requests"),
    "record_drive_feedback": _verdicts(changes.record_drive_feedback, "drive_feedback_requests"),
    "record_product_feedback": _verdicts(changes.record_product_feedback, "product_feedback_requests"),
    "record_donations": _verdicts(changes.record_donations, "donation_requests"),
    "record_donations_table": _table(
        changes.record_donations,
        "donation_requests",
        "donations",
        *("id", "donor_name", "amount", "organiser_id", "donation_date", "status"),
    ),
}

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    **IMPACT,
    **ORGANISERS,
    **MARKETPLACE,
    **RECOMMENDER,
    **CHANGES,
}
def _appended_donations(t: Tables) -> DataFrame:
    """Accepted donations appended to a stored table and read back."""
    columns = ("id", "donor_name", "amount", "organiser_id", "donation_date", "status")
    folder = new_folder(t.spark, "donations")
    change = changes.record_donations(t, request_batch(t, "donation_requests"))
    append_rows(t.donations.select(*columns), folder, "stored")
    append_rows(change.tables["new_donations"].select(*columns), folder, "requests")
    return appended_rows(t.spark, folder)


def _exported_donations(t: Tables) -> DataFrame:
    """The donation feed written as JSON lines and read back as text."""
    folder = new_folder(t.spark, "json")
    export_json(impact.donations_export(t, ordered=False), folder)
    return t.spark.read.text(folder).withColumnRenamed("value", "json")


STORED: dict[str, Callable[[Tables], DataFrame]] = {
    "catalog": lambda t: row_counts(t, TABLE_NAMES),
    "append_rows": _appended_donations,
    "export_json": _exported_donations,
}
REPORTS.update(STORED)

# Streams read the event files of the folder themselves.
STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "live_impact": jobs.live_impact,
    "donations_by_day": jobs.donations_by_day,
    "corrected_donations": jobs.corrected_donations,
    "first_join": jobs.first_join,
    "stock_ledger": lambda spark, folder: jobs.stock_ledger(
        request_stream(jobs.event_stream(spark, folder), "stock_requests"), benchmark_tables(spark, folder)
    ),
}


# Whole numbers that can be missing leave as floating-point numbers, because table formats outside Spark disagree on how
# to hold a missing integer.
GAPS: dict[str, tuple[str, ...]] = {
    "drive_overview": ("organiser_id", "products_recycled"),
    **dict.fromkeys(
        (
            *("donations_filtered", "donations_filtered_range", "update_drives_table", "update_drives_parts", "award_badges", "award_badges_bucketed"),
            *("record_donations", "record_donations_table", "append_rows"),
        ),
        ("organiser_id",),
    ),
    **dict.fromkeys(
        (
            *("organiser_drives", "organiser_completed_drives", "joinable_drives", "public_drives"),
            *("record_products_table", "volunteer_history"),
        ),
        ("products_recycled",),
    ),
    "record_products": ("organiser_id", "products_recycled"),
    "update_drives": ("organiser_id",),
    "drive_volunteer_names": ("position",),
    **dict.fromkeys(
        (
            *("featured_products", "pending_products", "approved_catalog", "approved_catalog_slim", "product_search"),
            *("product_search_term", "product_search_wildcards", "product_search_backslash", "apply_purchases_stock", "apply_purchases_parts", "checkout_stock", "decrement_stock_table", "decrement_stock_parts"),
            *("search_recommendations", "search_recommendations_term"),
        ),
        ("quantity",),
    ),
    **dict.fromkeys(
        ("feedback_by_drive", "feedback_by_drive_name", "purchase_history_view", "record_drive_feedback"), ("rating",)
    ),
}


def _exchange(name: str, df: DataFrame) -> DataFrame:
    """A result in exchange form."""
    return plain_types(df).withColumns({c: F.col(c).cast("double") for c in GAPS.get(name, ())})


def _exchange_sql(name: str, statement: str) -> str:
    """A statement whose result is in exchange form."""
    if name not in GAPS:
        return statement
    casts = ", ".join(f"cast({c} as double) as {c}" for c in GAPS[name])
    return f"select * replace ({casts}) from ({statement})"


def _stream(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain_types(job(tune(spark), sf_dir))


def _query(name: str, report: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _exchange(name, report(benchmark_tables(tune(spark), sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    reports = {name: _query(name, report) for name, report in REPORTS.items()}
    return {**reports, **{name: _stream(job) for name, job in STREAMS.items()}}


def statements() -> dict[str, str]:
    """The same results as SQL over the benchmark tables."""
    modules = (impact_sql, organisers_sql, marketplace_sql, recommend_sql, changes_sql, flows_sql)
    return {name: _exchange_sql(name, text) for module in modules for name, text in module.STATEMENTS.items()}
