"""SQL statements for the recommender; small enough data is ranked pair by pair here."""

from tidecrew.oracle.mapping import oracle
from tidecrew.oracle.organisers import day, ts

TRAINING = """
    select ph.id as purchase_id, f.user_id, f.product_id, f.rating, p.category, p.price, ph.purchase_date
    from product_feedback f join purchases ph on f.purchase_history_id = ph.id join products p on f.product_id = p.id"""

EDGES = """
    select list_distinct([lo[1] * 5, lo[2] * 5 + (hi[2] - lo[2]) * r[2], lo[3] * 5 + (hi[3] - lo[3]) * r[3],
                          lo[4] * 5 + (hi[4] - lo[4]) * r[4], lo[5] * 5 + (hi[5] - lo[5]) * r[5]]) as edges
    from (select [prices[((n - 1) * k) // 5 + 1] for k in [0, 1, 2, 3, 4]] as lo,
                 [prices[least(((n - 1) * k) // 5 + 2, n)] for k in [0, 1, 2, 3, 4]] as hi,
                 [((n - 1) * k) % 5 for k in [0, 1, 2, 3, 4]] as r
          from (select list(cents order by cents) as prices, count(*) as n
                from (select cast(price * 100 as bigint) as cents from training)))"""

APPROVED = "select * from products where status = 'Approved'"

COUNTS = """
    select u.id as user_id, u.id in (select user_id from training) as known,
           (select count(distinct product_id) from purchases b where b.user_id = u.id) as bought,
           (select count(*) from approved) - (select count(distinct b.product_id) from purchases b
              where b.user_id = u.id and b.product_id in (select id from approved)) as available,
           (select count(*) from approved where id in (select product_id from training))
             - (select count(distinct b.product_id) from purchases b where b.user_id = u.id
                and b.product_id in (select id from approved) and b.product_id in (select product_id from training))
             as in_model
    from users u"""

KINDS = """
    select user_id, case when not known then 'popularity_fallback_new_user'
                         when bought = 0 then 'popularity_no_history'
                         when available = 0 then 'general_fallback'
                         when in_model = 0 then 'new_products_fallback' else 'personalized' end as type
    from counts"""

BOOSTS = """
    select user_id, category, row_number() over w - 1 as place,
           greatest(0.5::double, (count(*) over (partition by user_id) - (row_number() over w - 1)) * 0.4::double) as boost
    from (select ph.user_id, p.category, count(*) as n, avg(coalesce(f.rating, 3)) as rating
          from purchases ph join products p on ph.product_id = p.id
          left join product_feedback f on f.purchase_history_id = ph.id group by 1, 2)
    window w as (partition by user_id order by rating desc, n desc, category)"""

SCORES = """
    select p.id as product_id, p.category, (sum(r.rating) + 15)::double / (count(*) + 5)::double as base
    from approved p join training r on r.product_id = p.id group by 1, 2"""

CANDIDATES = """
    select k.user_id, s.product_id, s.category, s.base,
           row_number() over (partition by k.user_id, s.category order by s.product_id) as nth
    from kinds k, scores s
    where k.type = 'personalized'
      and not exists (select 1 from purchases b where b.user_id = k.user_id and b.product_id = s.product_id)"""

TOP = """
    select user_id, row_number() over (partition by user_id order by score desc, base desc, product_id) as position,
           product_id, score
    from (select c.user_id, c.product_id, c.base,
                 c.base * case when b.boost is not null then b.boost + 1 else 1.0::double end
                   * case when c.nth > 1 then 0.95::double else 1.0::double end as score
          from candidates c left join boosts b on b.user_id = c.user_id and b.category = c.category)
    qualify position <= 10"""


def user_list(kind: str, products: str, order: str) -> str:
    return f"""
        select k.user_id, k.type, row_number() over (partition by k.user_id
                 order by (p.id * k.user_id) % 100, {order}) as position, p.id as product_id
        from kinds k, ({products}) p where k.type = '{kind}' qualify position <= 5"""


BOUGHT = """select p.id, count(*) as n from products p join purchases ph on p.id = ph.product_id
            where p.status = 'Approved' group by p.id"""

ALL = f"""
    select user_id, 'personalized' as type, position, product_id from top
    union all {user_list('popularity_fallback_new_user', BOUGHT, 'p.n desc, p.id')}
    union all {user_list('popularity_no_history', APPROVED, 'p.popularity_score desc, p.created_at desc, p.id')}
    union all {user_list('general_fallback', APPROVED, 'p.created_at desc, p.id')}
    union all {user_list('new_products_fallback', APPROVED, 'p.created_at desc, p.id')}"""


PRIOR = {
    "sides": """
        select rating, case when (((purchase_id + 42) % 1000003) * 7919) % 1000003 % 5 = 0 then 'test' else 'train' end as side
        from training""",
    "shares": """
        select rating, count(*) filter (side = 'train')::double / (select count(*) from sides where side = 'train') as share
        from sides group by 1""",
}

# A cohort is compared pair by pair: users 50, 100, ... against every buyer; likewise all users, without that condition.
COHORT = {
    "amounts": "select user_id, product_id, count(*) as n from purchases group by 1, 2",
    "norms": "select user_id, cast(sum(n * n) as bigint) as norm from amounts group by 1",
    "pairs": """
        select a.user_id as target, b.user_id, cast(sum(a.n * b.n) as bigint) as dot
        from amounts a join amounts b using (product_id) where a.user_id % 50 = 0 group by 1, 2""",
    "alike": """
        select target, row_number() over (partition by target order by user_id <> target, closeness desc, user_id)
                 as position, user_id, dot, norm, closeness
        from (select t.user_id as target, s.user_id, coalesce(p.dot, 0) as dot, s.norm,
                     coalesce(p.dot, 0)::double * coalesce(p.dot, 0) / s.norm as closeness
              from (select user_id from norms where user_id % 50 = 0) t cross join norms s
              left join pairs p on p.target = t.user_id and p.user_id = s.user_id)
        qualify position <= 5""",
}
COHORT_OFFERS = {
    **COHORT,
    "cohort": "select id as target from users where id % 50 = 0",
    "personal": """
        select a.target, ph.product_id, count(*) as weight
        from alike a join purchases ph on ph.user_id = a.user_id
        where a.user_id <> a.target
          and not exists (select 1 from amounts o where o.user_id = a.target and o.product_id = ph.product_id)
        group by 1, 2 qualify row_number() over (partition by a.target order by count(*) desc, ph.product_id) <= 5""",
    "best": "select product_id, count(*) as weight from purchases group by 1 order by weight desc, product_id limit 5",
    "offers": """
        select target, 'personalized' as type, product_id, weight from personal
        where product_id in (select id from approved)
        union all
        select target, 'popular', product_id, weight from cohort, best
        where target not in (select target from personal) and product_id in (select id from approved)
          and not exists (select 1 from amounts o where o.user_id = target and o.product_id = best.product_id)""",
    "approved": APPROVED,
    "latest": "select id as product_id from approved order by created_at desc, id limit 5",
}


def of_everybody(parts: dict[str, str]) -> dict[str, str]:
    """The expressions of a cohort for all users."""
    whole = {name: text.replace("a.user_id % 50 = 0", "true").replace("user_id % 50 = 0", "true") for name, text in parts.items()}
    return {name: text.replace("id % 50 = 0", "true") for name, text in whole.items()}


def ranked(body: str, **more: str) -> str:
    return oracle(
        body,
        training=TRAINING,
        edges=EDGES,
        approved=APPROVED,
        counts=COUNTS,
        kinds=KINDS,
        boosts=BOOSTS,
        scores=SCORES,
        candidates=CANDIDATES,
        top=TOP,
        **more,
    )


def user_order(products: str, order: str) -> str:
    """The first five products for each of the 100 user endings."""
    return oracle(f"""
        select r.residue, row_number() over (partition by r.residue order by (p.id * r.residue) % 100, {order})
                 as position, p.id as product_id
        from (select unnest(generate_series(0, 99)) as residue) r, ({products}) p qualify position <= 5""")


SIMILAR = """
    select user_id, cast(sum(n * coalesce(own, 0)) as bigint) as dot, cast(sum(n * n) as bigint) as norm,
           cast(sum(n * coalesce(own, 0)) as double) * cast(sum(n * coalesce(own, 0)) as bigint) / sum(n * n) as closeness
    from (select user_id, product_id, count(*) as n from purchases group by 1, 2) a
    left join (select product_id, count(*) as own from purchases where user_id = (select user_id from busiest)
               group by 1) b using (product_id)
    group by 1 order by user_id <> (select user_id from busiest), closeness desc, user_id limit 5"""
BUSIEST = "select user_id from purchases group by 1 order by count(*) desc, 1 limit 1"

# The best first cut of every feature: all classes are equally likely before the first round.
ROOT = {
    "coded": """
        select r.purchase_id, dense_rank() over (order by r.rating) - 1 as label, u.band as user_band,
               dense_rank() over (order by r.product_id) - 1 as product_code,
               dense_rank() over (order by r.category) - 1 as category_code,
               greatest(len(list_filter(edges, lambda e: e < cast(r.price * 100 as bigint) * 5)) - 1, 0) as price_band,
               floor(epoch(timestamp '2001-07-15 00:00:00' - r.purchase_date) / 86400) as days_since_purchase
        from training r join (select user_id, ((row_number() over (order by user_id) - 1) * 32) // (count(*) over ()) as band
                              from (select distinct user_id from training)) u using (user_id), edges""",
    "long": """
        select label, feature, value::bigint as value from coded
        unpivot (value for feature in (user_band, product_code, category_code, price_band, days_since_purchase))""",
    "valued": """
        select feature, value, count(*) as n, count(*) over (partition by feature) as different,
               sum(count(*)) over (partition by feature) as total,
               sum(count(*)) over (partition by feature order by value) as up_to
        from long group by feature, value""",
    "bins": """
        select feature, value, min(value) over (partition by feature, case when different <= 256 then value
                                                else ((up_to - n) * 256) // total end) as least from valued""",
    "amounts": """
        select feature, least, k, count(*) as n, count_if(label = k) as own
        from long join bins using (feature, value), (select distinct label as k from coded) group by feature, least, k""",
    "derived": """
        select feature, least, k, ((n - own) * round(16777216 / many) + own * round(16777216 / many - 16777216)) / 16777216.0::double as g,
               n * round(16777216 * 2.0::double / many * (1 - 1.0::double / many)) / 16777216.0::double as h
        from amounts, (select count(distinct label)::double as many from coded)""",
    "sides": """
        select feature, least as threshold, k,
               coalesce(sum(g) over (partition by feature, k order by least rows between unbounded preceding and 1 preceding), 0) as lg,
               coalesce(sum(h) over (partition by feature, k order by least rows between unbounded preceding and 1 preceding), 0) as lh,
               sum(g) over (partition by feature, k order by least rows between current row and unbounded following) as rg,
               sum(h) over (partition by feature, k order by least rows between current row and unbounded following) as rh
        from derived""",
}

STATEMENTS = {
    "training_set": ranked(f"""
        select purchase_id, user_id, product_id, rating, category, cast(price as double) as price,
               {ts('purchase_date')} as purchase_date from training"""),
    "training_features": ranked(f"""
        select purchase_id, user_id, product_id, rating, category, cast(price as double) as price,
               {ts('purchase_date')} as purchase_date,
               cast(floor(epoch(timestamp '2001-07-15 00:00:00' - purchase_date) / 86400) as bigint) as days_since_purchase,
               cast(greatest(len(list_filter(edges, lambda e: e < cast(price * 100 as bigint) * 5)) - 1, 0) as bigint)
                 as price_band
        from training, edges"""),
    "active_raters": ranked(
        "select user_id, count(*) as ratings from training group by 1 having count(*) >= 3"
    ),
    "active_rater_check": ranked("""
        select count(*) as active_users, count(*) >= 5 as enough
        from (select user_id from training group by 1 having count(*) >= 3)"""),
    "rating_distribution": ranked("select rating, count(*) as ratings from training group by 1"),
    "rating_index": ranked("select rating, dense_rank() over (order by rating) - 1 as index from training group by 1"),
    "label_encoding": ranked("""
        select 'user' as kind, cast(user_id as varchar) as value, row_number() over (order by user_id) - 1 as index
        from training group by user_id
        union all select 'product', cast(product_id as varchar), row_number() over (order by product_id) - 1
        from training group by product_id
        union all select 'category', category, row_number() over (order by category) - 1 from training group by category"""),
    "train_test_split": ranked("""
        select purchase_id, rating,
               case when (((purchase_id + 42) % 1000003) * 7919) % 1000003 % 5 = 0 then 'test' else 'train' end as side
        from training"""),
    "model_metadata": ranked("""
        select (select string_agg(cast(rating as varchar), ',' order by rating) from (select distinct rating from training))
                 as index_to_rating, count(distinct rating) as num_classes, count(distinct user_id) as num_users,
               count(distinct product_id) as num_products, '2001-07-15 00:00:00' as training_date
        from training"""),
    "user_bands": ranked("""
        select user_id, cast(((row_number() over (order by user_id) - 1) * 32) // (count(*) over ()) as bigint) as user_band
        from (select distinct user_id from training)"""),
    "user_bands_fine": ranked("""
        select user_id, cast(((row_number() over (order by user_id) - 1) * 256) // (count(*) over ()) as bigint) as user_band
        from (select distinct user_id from training)"""),
    "expected_rating": ranked(
        "select product_id, round(avg(cast(rating as double)), 6) as expected from training group by 1"
    ),
    "prior_losses": ranked("""
        select side, count(*) as ratings, round(avg(-ln(greatest(share, 1e-15))), 6) as mlogloss,
               round(avg(case when rating = (select rating from shares order by share desc, rating limit 1)
                              then 1.0::double else 0.0::double end), 6) as accuracy
        from sides join shares using (rating) group by 1""", **PRIOR),
    "root_gains": ranked("""
        select k as label, feature, threshold, round(gain, 4) as gain
        from (select *, lg * lg / (lh + 1) + rg * rg / (rh + 1) - (lg + rg) * (lg + rg) / (lh + rh + 1) as gain
              from sides where lh >= 3 and rh >= 3)
        where gain > 1e-6 qualify row_number() over (partition by k, feature order by gain desc, threshold) = 1""", **ROOT),
    "model_store": ranked("""
        select count(*) as ratings, cast(count(*) * 1000 as bigint) as shares, cast(0 as bigint) as difference from training"""),
    "serving_features": ranked("""
        select p.id as product_id, p.category, c.code as product_code, coalesce(g.code, 0) as category_code,
               cast(case when p.price is null then 2 when p.price < 100 then 0 when p.price < 500 then 1
                    when p.price < 1000 then 2 when p.price < 5000 then 3 else 4 end as bigint) as price_band,
               cast(30 as bigint) as days_since_purchase
        from approved p
        join (select product_id, row_number() over (order by product_id) - 1 as code from training group by 1) c
          on c.product_id = p.id
        left join (select category, row_number() over (order by category) - 1 as code from training group by 1) g
          on g.category = p.category"""),
    "candidate_counts": ranked("select * from counts"),
    "recommendation_type": ranked("select * from kinds"),
    "mean_scores": ranked("select product_id, category, base, cast(0 as bigint) as user_band from scores"),
    "category_boost": ranked("select * from boosts"),
    "top_recommendations": ranked("select * from top"),
    "fallback_list": user_order(APPROVED, "p.created_at desc, p.id"),
    "popular_list": user_order(APPROVED, "p.popularity_score desc, p.created_at desc, p.id"),
    "bought_list": user_order(BOUGHT, "p.n desc, p.id"),
    "newest_products": oracle(f"""
        select id, name, category, cast(price as double) as price, {day('created_at')} as created_at
        from (select * from products where status = 'Approved' order by created_at desc, id limit 5)"""),
    "recommendations": ranked(ALL),
    "similar_users_all": oracle("select * from alike", **of_everybody(COHORT)),
    "cf_recommendations_all": oracle(
        """
        select * from offers union all
        select target, 'newest', product_id, 0 from cohort, latest where target not in (select target from offers)""",
        **of_everybody(COHORT_OFFERS),
    ),
    "similar_users_cohort": oracle("select * from alike", **COHORT),
    "cf_recommendations_cohort": oracle(
        """
        select * from offers union all
        select target, 'newest', product_id, 0 from cohort, latest where target not in (select target from offers)""",
        **COHORT_OFFERS,
    ),
    "similar_users": oracle("select * from alike", alike=SIMILAR, busiest=BUSIEST),
    "cf_recommendations": oracle(
        """
        select 'personalized' as type, w.product_id, w.weight
        from (select product_id, count(*) as weight from purchases
              where user_id in (select user_id from alike) and user_id <> (select user_id from busiest)
                and product_id not in (select product_id from purchases where user_id = (select user_id from busiest))
              group by 1 order by weight desc, product_id limit 5) w
        join products p on p.id = w.product_id where p.status = 'Approved'""",
        alike=SIMILAR,
        busiest=BUSIEST,
    ),
}
