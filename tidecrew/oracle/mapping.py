"""The domain datasets as common table expressions (FIXTURES.md section 2)."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "sizes": """
        select (select count(*) from supplier) as ns, (select count(*) from customer) as nc,
               (select count(*) from part) as np""",
    "users": """
        select s_suppkey as id, s_name as username,
               lower(replace(s_name, '#', '_')) || '@example.org' as email, cast(s_suppkey as varchar) as mobile,
               n_name as location, 'organiser' as role,
               timestamp '2001-07-15 00:00:00' - to_days(cast(s_suppkey % 365 as integer)) as created_at
        from supplier join nation on s_nationkey = n_nationkey
        union all
        select 1000000 + c_custkey, c_name, lower(replace(c_name, '#', '_')) || '@example.org',
               cast(1000000 + c_custkey as varchar),
               case when c_custkey % 7 = 0 then null
                    when c_custkey % 3 = 0 then (8 + c_custkey % 5) || '.5,' || (76 + c_custkey % 4) || '.25'
                    else n_name end,
               case when c_custkey % 10 <= 4 then 'volunteer' when c_custkey % 10 <= 8 then 'buyer' else 'other' end,
               timestamp '2001-07-15 00:00:00' - to_days(cast(c_custkey % 730 as integer))
        from customer join nation on c_nationkey = n_nationkey""",
    "drives": """
        select o_orderkey as id,
               case when o_orderkey % 97 = 0 then null
                    else (o_custkey * 7) % ns - case when ((o_custkey * 7) % ns) % 10 = 9 then 1 else 0 end
               end as organiser_id,
               'drive ' || (o_orderkey % 500) as event_name, cast(o_orderdate as date) as event_date,
               lpad(cast(6 + o_orderkey % 12 as varchar), 2, '0') || ':00:00' as event_time,
               1 + o_orderkey % 8 as num_volunteers,
               cast(100 + (o_orderkey % 50) * 10 as decimal(10,2)) as salary_per_volunteer,
               cast(8.5 + o_orderkey % 6 as double) as latitude, cast(76.25 + o_orderkey % 4 as double) as longitude,
               case when o_orderkey % 4 = 1 then '/static/uploads/drive_' || o_orderkey || '.jpg'
                    when o_orderkey % 4 = 2 then ' static/drive_' || o_orderkey || '.png '
                    when o_orderkey % 4 = 3 then 'drive_' || o_orderkey || '.gif' end as photo_path,
               case when o_orderkey % 13 = 0 then null when o_orderkey % 3 = 0 then 'gloves'
                    when o_orderkey % 3 = 1 then 'gloves,bags' else 'gloves,bags,water' end as supplies,
               case when o_orderkey % 53 = 0 then null
                    else case o_orderstatus when 'F' then 'Completed' when 'P' then 'Active' when 'O' then 'Upcoming'
                    end end as status,
               case when o_orderkey % 31 = 0 then null else o_orderkey % 40 end as products_recycled,
               cast(cast(o_orderdate as date) as timestamp) - interval 14 day as created_at,
               cast(null as double) as plastics_collected
        from orders, sizes""",
    "drive_volunteers": """
        select l_orderkey as event_id,
               1000000 + (l_partkey % cast(floor(nc / 10.0) as bigint)) * 10 + l_suppkey % 5 as volunteer_id,
               min(l_shipdate) as joined_date,
               case when max(l_linenumber) = 7 then null else max(l_quantity) / 2.0 end as plastics_collected,
               cast(max(l_linenumber) as bigint) as hours_worked,
               case max(l_returnflag) when 'R' then 'Paid' when 'N' then 'Pending' end as payment_status
        from lineitem, sizes group by 1, 2""",
    "products": """
        select p_partkey as id, p_name as name,
               case when p_partkey % 23 = 0 then null else p_type || ' ' || p_brand end as description,
               cast(((p_partkey * 7919) % 700000 + 500) / 100.0 as decimal(10,2)) as price,
               case when p_partkey % 6 = 0 then
                    cast(cast(((p_partkey * 7919) % 700000 + 500) / 100.0 as decimal(10,2)) * 0.9 as decimal(10,2))
               end as discounted_price,
               case when p_size % 3 = 0 then 'wholesale' else 'recycled' end as category,
               case when p_size % 3 = 0 then 'kg' else 'units' end as units,
               case when p_partkey % 29 = 0 then null when p_partkey % 11 = 0 then 0
                    else cast(p_size as bigint) end as quantity,
               case when p_partkey % 10 = 0 then 'Pending' when p_partkey % 10 = 1 then 'Rejected'
                    when p_partkey % 20 = 2 then 'Deleted' else 'Approved' end as status,
               p_partkey % ns as organiser_id,
               case when p_partkey % 5 = 0 then null else 'product_' || p_partkey || '.png' end as image_path,
               date '2000-01-01' + cast(p_partkey % 400 as integer) as created_at,
               p_partkey % 17 as popularity_score
        from part, sizes""",
    "purchases": """
        select l_orderkey * 1000000 + l_partkey as id, 1000000 + o_custkey as user_id, p.id as product_id,
               p.name as product_name, p.price, p.discounted_price, cast(sum(l_quantity) as bigint) as quantity,
               cast(p.price * cast(sum(l_quantity) as bigint) as decimal(14,2)) as total_amount,
               o_orderdate as purchase_date,
               case when o_orderstatus = 'O' then 'Pending' else 'Completed' end as status
        from lineitem join orders on l_orderkey = o_orderkey join products p on l_partkey = p.id
        group by l_orderkey, l_partkey, o_custkey, p.id, p.name, p.price, p.discounted_price, o_orderdate,
                 o_orderstatus""",
    "product_feedback": """
        select id * 10 as id, id as purchase_history_id, user_id, product_id, cast(1 + (id * 3) % 5 as integer) as rating,
               'comment ' || id as comment, purchase_date + interval 2 day as created_at
        from purchases where id % 3 = 0""",
    "donations": """
        select event_id as id, 'donor_' || user_id as donor_name, 'donor_' || user_id || '@example.org' as donor_email,
               cast(user_id as varchar) as donor_phone, cast(value as decimal(10,2)) as amount,
               case when event_id % 17 = 0 then null else event_id % ns end as organiser_id,
               ts - interval 8235 day as donation_date,
               case when event_id % 4 = 0 then 'Completed' else 'Pending' end as status
        from events, sizes where event_type = 'purchase'""",
    "volunteer_badges": """
        select v.event_id * 10000000 + v.volunteer_id as id, v.volunteer_id, v.event_id,
               case when v.plastics_collected < 20 then 'bronze' when v.plastics_collected < 22 then 'gold'
                    when v.plastics_collected < 24 then 'platinum' else 'Diamond' end as badge_type,
               v.joined_date as awarded_date
        from drive_volunteers v join drives d on d.id = v.event_id
        where d.status = 'Completed' and v.plastics_collected >= 18""",
    "drive_feedback": """
        select v.event_id, v.volunteer_id, cast(1 + (v.event_id + v.volunteer_id) % 5 as integer) as rating,
               'feedback ' || v.event_id || '-' || v.volunteer_id as feedback_text,
               v.joined_date + interval 3 day as submission_date
        from drive_volunteers v join drives d on d.id = v.event_id
        where d.status = 'Completed' and (v.event_id + v.volunteer_id) % 4 = 0""",
    "cart": """
        select c.user_id, c.product_id, p.name as product_name, c.quantity, p.price, p.discounted_price
        from (select 1000000 + user_id % nc as user_id, event_id % np as product_id, count(*) as quantity
              from events, sizes where event_type = 'click' group by 1, 2) c
        join products p on p.id = c.product_id""",
    "places": """
        select cast(8.5 + n_nationkey % 5 as double) as latitude, cast(76.25 + n_nationkey % 4 as double) as longitude,
               'Beach ' || min(n_nationkey) as display_name
        from nation group by 1, 2""",
}


def oracle(body: str, **extra: str) -> str:
    """``body`` preceded by the datasets it names; ``extra`` adds expressions of the query's own before it."""
    known = {**TABLES, **extra}
    if body.lstrip().startswith("with"):
        body = f"select * from ({body})"
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_body = sql
                needed.append(name)
                visit(visit_body)

    visit(body)
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in known:
            if other != name and re.search(rf"\b{other}\b", known[name]):
                place(other)
        ordered.append(name)

    for name in needed:
        place(name)
    ctes = ",\n".join(f"{name} as ({known[name]})" for name in ordered)
    recursive = "recursive " if any(re.search(rf"\b{n}\b", known[n]) for n in ordered) else ""
    return f"with {recursive}{ctes}\n{body}" if ordered else body
