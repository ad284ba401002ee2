"""SQL statements for catalogue, prices, carts, purchases, ratings and search."""

from tidecrew.oracle.mapping import oracle
from tidecrew.oracle.organisers import day, ts
from tidecrew.sources.requests import request_sql

IMAGE = """case when {p}.image_path is null then '/static/default-product.jpg'
                else '/static/uploads/' || {p}.image_path end as image_url"""
P_IMAGE = IMAGE.format(p="p")

# Best badge and discount per volunteer.
BEST = """
    select volunteer_id, max(case lower(badge_type) when 'bronze' then 1 when 'gold' then 2 when 'platinum' then 3
                             when 'diamond' then 4 else 0 end) as r
    from volunteer_badges group by 1"""
PCT = """
    select u.id as user_id, case when u.role = 'volunteer' then coalesce(b.r, 0) * 5 else 0 end as pct
    from users u left join best b on b.volunteer_id = u.id"""


def cents(price: str, pct: str) -> str:
    """A discounted price in exact cents, as a number."""
    return f"cast((cast({price} * 100 as bigint) * (100 - {pct}) + 50) // 100 as double) / 100"


def catalog(price_without_discount: str) -> str:
    return oracle(f"""
        select l.pct as discount_pct, p.id, p.name, p.category, u.username as organiser_name,
               cast(p.price as double) as original_price,
               case when l.pct > 0 then {cents('p.price', 'l.pct')} else {price_without_discount} end as discounted_price,
               case when p.quantity is null then 'Not Available'
                    when p.category = 'wholesale' then p.quantity || '.00 kg' else p.quantity || ' items' end
                 as formatted_quantity, {P_IMAGE}
        from products p join users u on u.id = p.organiser_id,
             (select unnest([0, 5, 10, 15, 20])::bigint as pct) l
        where p.status = 'Approved'""")


def search(term: str = "") -> str:
    """Approved products with their sales, which are counted first; ``term`` is a pattern in lower case."""
    return f"""
        with sales as (select product_id, count(*) as n from purchases group by product_id),
        texts as (select id, [lower(name), lower(description), lower(category)] as parts from products)
        select id, name, description, price, category, units, quantity, status, image_path,
               (select username from users where users.id = organiser_id) as organiser_name,
               coalesce((select n from sales where product_id = products.id), 0) as purchase_count
        from products semi join users on users.id = organiser_id
        where status = 'Approved'
          and id in (select id from texts where '{term}' = '' or len(list_filter(parts, lambda x: x like '%{term}%')) > 0)"""


TERM = "bolt"
BACKSLASH = "bolt\\"
TERM_SCORE = """+ case when contains(lower(name), 'bolt') then 3 else 0 end
                + case when contains(lower(description), 'bolt') then 2 else 0 end
                + case when contains(lower(category), 'bolt') then 1 else 0 end"""


def recommended(where: str, extra_score: str, keep: str) -> str:
    return oracle(
        f"""
        select id, name, category, cast(price as double) as price, quantity, organiser_name, purchase_count,
               cast(least(purchase_count, 5)
                    + case when abs(price * (select count(*) from found) - (select sum(price) from found)) * 5
                                <= (select sum(price) from found) then 2 else 0 end
                    + case when quantity > 0 then 1 else 0 end {extra_score} as bigint) as score
        from found where {keep} order by score desc, id desc limit 5""",
        found=search(where),
    )


# Every term of a table against every product.
TERM_TABLE = {
    "search_terms": request_sql("search_terms"),
    "wanted": r"select distinct lower(regexp_replace(coalesce(term, ''), '^\s+|\s+$', '', 'g')) as term from search_terms",
    "listing": search(),
    "hits": """
        select w.term, l.* from listing l, wanted w
        where w.term = '' or lower(l.name) like '%' || w.term || '%' or lower(l.description) like '%' || w.term || '%'
              or lower(l.category) like '%' || w.term || '%'""",
    "means": "select term, sum(price) as total, count(price) as n from hits group by term",
}


PURCHASE_VIEW = f"""
    select ph.id, ph.user_id, ph.product_id, p.name as product_name, ph.quantity, cast(p.price as double) as price,
           case when x.pct > 0 then {cents('p.price', 'x.pct')} end as discounted_price,
           cast(ph.total_amount as double) as total_amount, {ts('ph.purchase_date')} as purchase_date, ph.status,
           {P_IMAGE}, f.rating, f.comment
    from purchases ph join products p on ph.product_id = p.id
    left join product_feedback f on f.purchase_history_id = ph.id left join pct_of x on x.user_id = ph.user_id"""


def purchases_where(condition: str) -> str:
    return oracle(f"""
        select id, user_id, product_name, quantity, cast(total_amount as double) as total_amount,
               {ts('purchase_date')} as purchase_date, status
        from purchases where {condition}""")


def with_discounts(body: str) -> str:
    return oracle(body, best=BEST, pct_of=PCT)


STATEMENTS = {
    "approved_catalog": oracle(f"""
        select p.id, p.name, p.description, cast(p.price as double) as price, p.category, p.units, p.quantity, p.status,
               p.image_path, p.organiser_id, u.username as organiser_name, {day('p.created_at')} as created_at
        from products p join users u on p.organiser_id = u.id where p.status = 'Approved'"""),
    "approved_catalog_slim": oracle("""
        select id, name, description, image_path, cast(price as double) as price, quantity, category
        from products where status = 'Approved'"""),
    "highest_badge": with_discounts("""
        select volunteer_id, case r when 1 then 'bronze' when 2 then 'gold' when 3 then 'platinum' else 'diamond' end
                 as highest_badge, cast(r as bigint) as badge_rank from best"""),
    "volunteer_discount": with_discounts("""
        select u.id as user_id, u.role, cast(x.pct as bigint) as discount_pct
        from users u join pct_of x on x.user_id = u.id"""),
    "priced_catalog": catalog("cast(p.price as double)"),
    "priced_catalog_search": catalog("null"),
    "cart_contents": with_discounts(f"""
        select c.user_id, c.product_id, c.product_name, c.quantity, cast(p.price as double) as price,
               cast(p.price as double) as original_price,
               case when x.pct > 0 then {cents('p.price', 'x.pct')} end as discounted_price, p.image_path, {P_IMAGE}
        from cart c join products p on c.product_id = p.id left join pct_of x on x.user_id = c.user_id"""),
    "cart_count": oracle("""
        select u.id as user_id, cast(coalesce(sum(c.quantity), 0) as bigint) as cart_count
        from users u left join cart c on c.user_id = u.id group by 1"""),
    "cart_total": oracle("""
        select c.user_id, cast(sum(c.quantity * coalesce(p.discounted_price, p.price)) as double) as cart_total
        from cart c join products p on c.product_id = p.id group by 1"""),
    "cart_total_badge": with_discounts("""
        select c.user_id, cast(sum(c.quantity * case when x.pct > 0
                 then (cast(p.price * 100 as bigint) * (100 - x.pct) + 50) // 100
                 else cast(p.price * 100 as bigint) end) as double) / 100 as cart_total
        from cart c join products p on c.product_id = p.id left join pct_of x on x.user_id = c.user_id group by 1"""),
    "purchase_history_view": with_discounts(PURCHASE_VIEW),
    "purchase_totals": with_discounts("""
        select ph.id, ph.user_id, cast(s.shown as double) / 100 as display_price,
               cast(cast(p.price * 100 as bigint) - s.shown as double) / 100 as savings,
               cast(s.shown * ph.quantity as double) / 100 as total
        from purchases ph join products p on ph.product_id = p.id join pct_of x on x.user_id = ph.user_id,
             lateral (select (cast(p.price * 100 as bigint) * (100 - x.pct) + 50) // 100 as shown) s"""),
    "purchase_filter_all": purchases_where("true"),
    "purchase_filter_completed": purchases_where("lower(status) = 'completed'"),
    "purchase_filter_pending": purchases_where("lower(status) = 'pending'"),
    "product_rating_summary": oracle("""
        select p.id, p.name, coalesce(avg(f.rating), 0) as average_rating, count(f.id) as feedback_count
        from products p left join product_feedback f on p.id = f.product_id group by p.id, p.name"""),
    "product_rating": oracle("""
        select p.id as product_id, count(f.id) as feedback_count,
               case when count(f.id) = 0 then 0.0
                    else cast((200 * sum(f.rating) + count(f.id)) // (2 * count(f.id)) as double) / 100.0 end as average_rating
        from products p left join product_feedback f on p.id = f.product_id group by p.id"""),
    "latest_feedback": oracle(f"""
        select * from (
          select f.product_id, row_number() over (partition by f.product_id order by f.created_at desc, f.id desc)
                   as position, u.username, f.rating, f.comment, {ts('f.created_at')} as date
          from product_feedback f join users u on f.user_id = u.id) where position <= 5"""),
    "product_search": oracle(f"select * replace (cast(price as double) as price) from ({search()})"),
    "product_search_term": oracle(f"select * replace (cast(price as double) as price) from ({search(TERM)})"),
    "product_search_wildcards": oracle(f"select * replace (cast(price as double) as price) from ({search('b_lt%')})"),
    "product_search_backslash": oracle(f"select * replace (cast(price as double) as price) from ({search(BACKSLASH)})"),
    "search_table": oracle("select term, id, name, purchase_count from hits", **TERM_TABLE),
    "search_table_recommendations": oracle("""
        select term, row_number() over (partition by term order by score desc, id desc) as position, id, name,
               cast(price as double) as price, purchase_count, score
        from (select h.*, cast(least(purchase_count, 5) + case when abs(coalesce(price, 0) * n - total) * 5 <= total then 2 else 0 end
                     + case when quantity > 0 then 1 else 0 end
                     + case when h.term <> '' and contains(lower(name), h.term) then 3 else 0 end
                     + case when h.term <> '' and contains(lower(description), h.term) then 2 else 0 end
                     + case when h.term <> '' and contains(lower(category), h.term) then 1 else 0 end as bigint) as score
              from hits h join means m on m.term = h.term where h.term = '' or description is not null)
        qualify position <= 5""", **TERM_TABLE),
    "search_recommendations": recommended("", "", "true"),
    "search_recommendations_term": recommended(TERM, TERM_SCORE, "description is not null"),
}
