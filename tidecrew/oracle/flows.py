"""SQL statements for the streams and stored results."""

from tidecrew.oracle.changes import STATEMENTS as CHANGES
from tidecrew.oracle.mapping import oracle

COUNTED = (
    *("users", "drives", "drive_volunteers", "drive_feedback", "volunteer_badges"),
    *("donations", "products", "purchases", "product_feedback", "cart"),
)

STATEMENTS = {
    "catalog": oracle(
        " union all ".join(f"select '{n}' as name, count(*) as rows from {n}" for n in COUNTED)
        + " union all select 'system_settings', 3"
    ),
    "live_impact": """
        select event_type, count(*) as events, cast(sum(cast(value as decimal(10,2))) as double) as amount
        from events group by 1""",
    "donations_by_day": """
        select strftime(ts, '%Y-%m-%d') as day, count(*) as donations,
               cast(sum(cast(value as decimal(10,2))) as double) as amount
        from events where event_type = 'purchase' group by 1, date_trunc('day', ts)
        having date_trunc('day', ts) + interval 1 day
               <= (select max(ts) - interval 1 hour from events where event_type = 'purchase')""",
    "corrected_donations": """
        select strftime(ts, '%Y-%m-%d') as day, count(*) as donations,
               cast(sum(cast(value as decimal(10,2))) as double) as amount, cast(0 as bigint) as late_donations
        from events where event_type = 'purchase' group by 1, date_trunc('day', ts)
        having date_trunc('day', ts) + interval 1 day
               <= (select max(ts) - interval 1 hour from events where event_type = 'purchase')""",
    "first_join": "select distinct user_id, event_type from events",
    "stock_ledger": CHANGES["decrement_stock"],
    **{f"{name}_parts": CHANGES[name] for name in ("update_users", "review_products", "upsert_by_key", "record_work")},
    "decrement_stock_parts": CHANGES["decrement_stock_table"],
    "update_drives_parts": CHANGES["update_drives_table"],
    "apply_purchases_parts": CHANGES["apply_purchases_stock"],
    **{f"{name}_bucketed": CHANGES[name] for name in ("register_users", "join_drives", "award_badges", "record_product_feedback")},
    "append_rows": CHANGES["record_donations_table"],
    "export_json": oracle("""
        select '{"id":' || d.id || ',"donor_name":"' || d.donor_name || '","amount":' || cast(d.amount as double)
               || ',"donation_date":"' || strftime(d.donation_date, '%Y-%m-%dT%H:%M:%S') || '","organiser_name":"'
               || coalesce(u.username, 'Unknown') || '"}' as json
        from donations d left join users u on d.organiser_id = u.id"""),
}
