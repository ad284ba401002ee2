"""Request batches for the change jobs, derived from the benchmark tables.

The texts are plain SQL; ``{name}`` stands for a base table or domain dataset.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidecrew.sources.catalog import Tables

REQUESTS: dict[str, str] = {
    "registrations": """
        select event_id as request_id, case when event_id % 19 = 0 then '' else 'member_' || event_id end as username,
               case when event_id % 5 = 0
                    then 'customer_' || lpad(event_id % (select count(*) from {customer}) || '', 9, '0') || '@example.org'
                    else 'member_' || user_id || '@example.org' end as email,
               case when event_id % 23 = 0 then null else event_id || '' end as mobile,
               'NATION_' || event_id % 25 as location,
               case when event_id % 2 = 0 then 'volunteer' else 'buyer' end as role
        from {events} where event_type = 'signup'""",
    "user_updates": """
        select c_custkey * 2 + c.copy as request_id, 1000000 + c_custkey as id,
               case when c.copy = 1 then 'again_' else 'renamed_' end || c_custkey as username,
               'renamed_' || c_custkey || '@example.org' as email, '0' || c_custkey as mobile,
               'NATION_' || c_nationkey as location, 'buyer' as role
        from {customer} join (select 'BUILDING' as segment, 0 as copy union all select 'BUILDING', 1) c
          on c.segment = c_mktsegment
        where c.copy = 0 or c_custkey % 3 = 0""",
    "cart_upserts": """
        select c.copy as request_id, 1000000 + user_id % (select count(*) from {customer}) as user_id,
               event_id % 60 as product_id,
               'viewed ' || event_id % 60 as product_name, count(*) + c.copy as quantity,
               cast(event_id % 60 + 0.5 as decimal(10,2)) as price, cast(null as decimal(10,2)) as discounted_price
        from {events} join (select 'view' as kind, 0 as copy union all select 'view', 1) c on c.kind = event_type
        where c.copy = 0 or event_id % 4 = 0
        group by 1000000 + user_id % (select count(*) from {customer}), event_id % 60, c.copy""",
    "new_drives": """
        select o_orderkey as request_id, (o_custkey * 7) % (select count(*) from {supplier}) as organiser_id,
               'new drive ' || o_orderkey as event_name, cast(o_orderdate as date) as event_date,
               '10:00:00' as event_time, cast(9.5 as double) as latitude, cast(77.25 as double) as longitude,
               2 + o_orderkey % 5 as num_volunteers,
               cast(120 + o_orderkey % 7 as decimal(10,2)) as salary_per_volunteer,
               cast(null as {text}) as photo_path, 'gloves,water' as supplies
        from {orders} where o_orderpriority = '5-LOW'""",
    "drive_updates": """
        select o_orderkey * 2 + c.copy as request_id, o_orderkey as id,
               case when o_orderkey % 11 = 0 then null
                    else (o_custkey * 7) % (select count(*) from {supplier}) end as organiser_id,
               case when c.copy = 1 then 'again ' else 'renamed ' end || o_orderkey as event_name, cast(date '2001-08-01' as date) as event_date,
               '09:30:00' as event_time, 3 + o_orderkey % 5 as num_volunteers,
               cast(150 + o_orderkey % 9 as decimal(10,2)) as salary_per_volunteer, 'Active' as status
        from {orders} join (select '2-HIGH' as priority, 0 as copy union all select '2-HIGH', 1) c
          on c.priority = o_orderpriority
        where c.copy = 0 or o_orderkey % 3 = 0""",
    "drive_deletions": """
        select o_orderkey as event_id, (o_custkey * 7) % (select count(*) from {supplier}) as organiser_id
        from {orders} where o_orderpriority = '1-URGENT'""",
    "user_deletions": "select 1000000 + c_custkey as user_id from {customer} where c_mktsegment = 'MACHINERY'",
    "product_reviews": """
        select p_partkey * 2 + c.copy as request_id, p_partkey as id,
               case when (p_size + c.copy) % 2 = 0 then 'Approved' else 'Rejected' end as status
        from {part} join (select 'ECONOMY' as type, 0 as copy union all select 'ECONOMY', 1) c on c.type = p_type
        where c.copy = 0 or p_partkey % 3 = 0""",
    "join_requests": """
        select event_id as request_id, event_id * 7 % 200 as event_id,
               1000000 + (user_id % cast(floor((select count(*) from {customer}) / 10.0) as bigint)) * 10
                 + event_id % 5 as volunteer_id
        from {events} where event_type = 'view'""",
    "badge_requests": """
        select v.event_id * 10000000 + v.volunteer_id + c.copy as request_id, v.volunteer_id, v.event_id,
               case when v.hours_worked = 6 then null when v.hours_worked = 5 then 'gold' else 'bronze' end as badge_type,
               case when v.event_id % 6 = 0 then d.organiser_id + 1 else d.organiser_id end as organiser_id
        from {drive_volunteers} v join {drives} d on d.id = v.event_id
        join (select 'Paid' as payment_status, 0 as copy union all select 'Pending', 0
              union all select 'Paid', 5000000) c on c.payment_status = v.payment_status""",
    "work_records": """
        select c.copy as request_id, event_id, volunteer_id, (hours_worked + c.copy) * 1.5 as plastics_collected,
               hours_worked + 1 + c.copy as hours_worked
        from {drive_volunteers} v
        join (select 'Pending' as payment_status, 0 as copy union all select 'Pending', 1) c
          on c.payment_status = v.payment_status
        where c.copy = 0 or v.volunteer_id % 3 = 0""",
    "recycled_records": """
        select o_orderkey * 2 + c.copy as request_id, o_orderkey as event_id,
               case when o_orderkey % 11 = 0 then null
                    else (o_custkey * 7) % (select count(*) from {supplier}) end as organiser_id,
               case when o_orderkey % 8 = 0 then null else o_orderkey % 90 + c.copy end as products_recycled
        from {orders} join (select '3-MEDIUM' as priority, 0 as copy union all select '3-MEDIUM', 1) c
          on c.priority = o_orderpriority
        where c.copy = 0 or o_orderkey % 3 = 0""",
    "uploads": """
        select p_partkey as request_id, p_partkey % 10 as organiser_id,
               case when p_partkey % 37 = 0 then '  ' when p_partkey % 4 = 0 then p_name
                    else 'new ' || p_partkey % 300 end as name,
               case p_size % 9 when 0 then ' Wholesale' when 1 then 'recycled' when 2 then 'other' when 3 then ''
                    when 4 then 'wholesale' else 'RECYCLED ' end as product_type,
               case p_partkey % 11 when 0 then 'abc' when 1 then '-5' when 2 then '0' when 3 then ''
                    else p_partkey % 900 + 5 || '.50' end as price,
               case p_partkey % 13 when 0 then 'many' when 1 then '0.4' when 2 then '' else p_size || '.75' end as quantity,
               case when p_partkey % 29 = 0 then ' ' else p_type end as description,
               case p_partkey % 17 when 0 then null when 1 then '' when 2 then 'photo.exe' when 3 then 'photo'
                    when 4 then 'photo.JPG' else 'photo.png' end as file_name
        from {part}""",
    "purchase_requests": """
        select event_id as request_id, 1000000 + user_id as user_id,
               event_id % ((select count(*) from {part}) + 7) as product_id, 1 + event_id % 3 as quantity,
               event_id % 2 = 0 as from_cart
        from {events} where event_type = 'purchase'""",
    "cart_adds": """
        select event_id as request_id, 1000000 + user_id % (select count(*) from {customer}) as user_id,
               case when event_id % 41 = 0 then 99999999 else event_id % 90 end as product_id
        from {events} where event_type = 'view'""",
    "cart_quantities": """
        select (user_id - 1000000) * 10000000 + product_id as request_id, user_id, product_id,
               (user_id + product_id) % 40 as quantity
        from {cart}""",
    "cart_removals": """
        select 1000000 + user_id % (select count(*) from {customer}) as user_id, event_id % 60 as product_id
        from {events} where event_type = 'error'""",
    "checkout_lines": """
        select user_id as cart_id, product_id as line_no,
               case when product_id % 31 = 0 then null when product_id % 97 = 0 then 99999999 else product_id end
                 as product_id, quantity * (1 + product_id % 20) as quantity
        from {cart}""",
    "stock_requests": """
        select event_id as request_id, event_id % 60 as product_id, 1 + event_id % 9 as quantity
        from {events} where event_type = 'purchase'""",
    "drive_feedback_requests": """
        select event_id * 10000000 + volunteer_id as request_id, event_id, volunteer_id,
               case when hours_worked = 2 then null else hours_worked % 5 + 1 end as rating,
               case when hours_worked = 3 then '' else 'fine ' || event_id end as feedback_text
        from {drive_volunteers} where payment_status = 'Paid'""",
    "product_feedback_requests": """
        select p.id * 2 + c.copy as request_id, p.id as purchase_id, p.user_id, p.product_id,
               cast((p.id + c.copy) % 7 as bigint) as rating, 'note ' || p.id as comment
        from {purchases} p
        join (select 'Completed' as status, 0 as copy union all select 'Completed', 1 union all select 'Pending', 0) c
          on c.status = p.status""",
    "donation_requests": """
        select event_id as request_id, case when event_id % 19 = 0 then '' else 'donor_' || user_id end as donor_name,
               'donor_' || user_id || '@example.org' as donor_email, user_id || '' as donor_phone,
               cast(value as decimal(10,2)) as amount,
               case when event_id % 17 = 0 then null else event_id % (select count(*) from {supplier}) end as organiser_id
        from {events} where event_type = 'purchase'""",
    "reported_points": """
        select event_id as request_id,
               case when event_id % 41 = 0 then null when event_id % 43 = 0 then cast(95 as double)
                    else cast(80000 + event_id * 7919 % 60000 as double) / 10000 end as latitude,
               cast(760000 + event_id * 104729 % 40000 as double) / 10000 as longitude
        from {events}""",
    "collection_points": """
        select cast(80000 + c_custkey * 611953 % 60000 as double) / 10000 as latitude,
               cast(760000 + c_custkey * 15485863 % 40000 as double) / 10000 as longitude,
               case when c_custkey % 37 = 0 then null else 'point ' || c_custkey % 900 end as display_name
        from {customer}""",
    "search_terms": """
        select p_partkey as request_id,
               case p_partkey % 9 when 0 then substr(p_name, 1, 4) when 1 then ' ' || upper(substr(p_name, 2, 3)) || ' '
                    when 2 then substr(p_name, 1, 2) when 3 then substr(p_name, 1, 2) || '_' || substr(p_name, 4, 2)
                    when 4 then substr(p_name, 1, 1) || '%' || substr(p_name, 5, 3) when 5 then substr(p_name, 1, 3) || chr(92)
                    when 6 then substr(p_type, 1, 5) when 7 then '__' end as term
        from {part} where p_size % 10 = 3""",
}

_BASE = ("events", "customer", "part", "supplier", "orders")


def _names(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text)) - {"text"}


def request_batch(t: Tables, name: str) -> DataFrame:
    """A batch as a DataFrame."""
    text = REQUESTS[name]
    frames = {n: getattr(t, f"raw_{n}" if n in _BASE else n) for n in _names(text)}
    return t.spark.sql(text.replace("{text}", "string"), **frames)


def request_sql(name: str) -> str:
    """A batch as SQL text for a plain engine."""
    text = REQUESTS[name].replace("{text}", "varchar")
    return text.format(**{n: n for n in _names(text)})


def request_stream(events: DataFrame, name: str) -> DataFrame:
    """A batch that only needs the events, over a stream of them."""
    return events.sparkSession.sql(REQUESTS[name].replace("{text}", "string"), events=events)
