"""SQL statements for the change jobs."""

from tidecrew.oracle.mapping import oracle
from tidecrew.oracle.marketplace import BEST, PCT
from tidecrew.oracle.organisers import day, ts
from tidecrew.sources.requests import REQUESTS, request_sql

BATCHES = {name: request_sql(name) for name in REQUESTS}


def on(body: str, **extra: str) -> str:
    return oracle(body, **BATCHES, **extra)


REGISTERED = """
    select r.*, coalesce(username, '') = '' or coalesce(email, '') = '' or coalesce(mobile, '') = ''
                  or coalesce(location, '') = '' or coalesce(role, '') = '' as blank,
           email in (select email from users) as taken
    from registrations r"""
REGISTER_VERDICTS = """
    select request_id, username, email, mobile, location, role,
           case when blank then 'All fields are required.'
                when taken or coalesce(min(case when not blank and not taken then request_id end)
                                         over (partition by email), request_id) < request_id
                  then 'Email already exists.' end as reason
    from registered"""



def last(batch: str, *keys: str, where: str = "true") -> str:
    """The last request of every key."""
    return f"""(select * from {batch} where {where}
                qualify row_number() over (partition by {", ".join(keys)} order by request_id desc) = 1)"""


OWN_DRIVE = "exists (select 1 from drives o where o.id = {id} and o.organiser_id = {batch}.organiser_id)"
LAST_WORK = last("work_records", "event_id", "volunteer_id")

USER = """id, username, email, mobile, location, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"""

DRIVE_KEEP = """
    select 'drives' as kept_table, id as event_id, cast(0 as bigint) as volunteer_id from drives d where {drive}
    union all select 'drive_volunteers', event_id, volunteer_id from drive_volunteers c where {child}
    union all select 'drive_feedback', event_id, volunteer_id from drive_feedback c where {child}
    union all select 'volunteer_badges', event_id, volunteer_id from volunteer_badges c where {badge}"""
OWNED = """d.id in (select event_id from drive_deletions r where r.organiser_id = d.organiser_id)"""
CHILD_OWNED = """c.event_id in (select d.id from drives d join drive_deletions r
                                on r.event_id = d.id and r.organiser_id = d.organiser_id)"""
CHILD_ASKED = "c.event_id in (select event_id from drive_deletions)"


def kept(drive: str, child: str, badge: str) -> str:
    return on(DRIVE_KEEP.format(drive=drive, child=child, badge=badge))


JOINED = """
    select r.*, exists (select 1 from drive_volunteers v where v.event_id = r.event_id
                        and v.volunteer_id = r.volunteer_id) as joined
    from join_requests r"""

BADGE_CHECKS = """
    select r.*, r.badge_type is null as missing,
           exists (select 1 from volunteer_badges b where b.event_id = r.event_id
                   and b.volunteer_id = r.volunteer_id) as awarded,
           exists (select 1 from drives d where d.id = r.event_id and d.organiser_id = r.organiser_id
                   and d.status = 'Completed') as owned
    from badge_requests r"""

UPLOAD_ROWS = """
    select request_id, organiser_id, trim(name) as name, lower(trim(product_type)) as kind, price as price_text,
           quantity as quantity_text, trim(description) as description, file_name, try_cast(price as double) as price,
           try_cast(quantity as double) as amount
    from uploads"""
UPLOAD_RULES = """
    select *, case when kind = 'recycled' then trunc(amount) else amount end as pieces,
           case when name = '' then 'Product name is required' when kind = '' then 'Product type is required'
                when price_text = '' then 'Price is required' when quantity_text = '' then 'Quantity is required'
                when description = '' then 'Description is required' end as required,
           case when price is null then 'Invalid price format. Please enter a valid number.'
                when price <= 0 then 'Price must be greater than 0'
                when kind = 'wholesale' and amount is null
                  then 'For wholesale products, quantity must be a valid number in kilograms'
                when kind = 'recycled' and amount is null then 'For recycled products, quantity must be a whole number'
                when kind not in ('wholesale', 'recycled')
                  then 'Invalid product type: ' || kind || '. Must be wholesale or recycled.'
                when case when kind = 'recycled' then trunc(amount) else amount end <= 0
                  then 'Quantity must be greater than 0'
                when file_name is null then 'Please upload a product image' when file_name = '' then 'No image selected'
                when not regexp_matches(lower(file_name), '\\.(png|jpg|jpeg|gif)$') then 'Invalid image format'
           end as later,
           exists (select 1 from products p where p.organiser_id = u.organiser_id and p.name = u.name
                   and p.status <> 'Deleted') as listed
    from upload_rows u"""

BUYING = """
    select r.request_id, r.user_id, r.product_id, p.name as product_name, r.quantity, p.price, x.pct, r.from_cart,
           p.quantity as stock, p.id is null as unknown
    from purchase_requests r left join products p on p.id = r.product_id left join pct_of x on x.user_id = r.user_id"""
BOUGHT_OK = "(select * from buying where not unknown and stock is not null)"

ADDS = """
    select a.user_id, a.product_id, a.asked, p.id is null as unknown, p.name, p.quantity as stock, p.price,
           case when u.role = 'volunteer' then p.discounted_price end as offer, c.quantity as present,
           case when p.id is null or coalesce(p.quantity, 0) <= 0 then 0
                else least(a.asked, greatest(p.quantity - coalesce(c.quantity, 0),
                                             case when c.quantity is null then 1 else 0 end)) end as added
    from (select user_id, product_id, count(*) as asked from cart_adds group by 1, 2) a
    left join products p on p.id = a.product_id left join users u on u.id = a.user_id
    left join cart c on c.user_id = a.user_id and c.product_id = a.product_id"""

SET_CHECKS = """
    select r.*, case when p.id is null then 'Product not found' when r.quantity < 1 then 'Quantity must be at least 1'
                     when p.quantity is null or r.quantity > p.quantity then 'Requested quantity not available'
                end as reason
    from cart_quantities r left join products p on p.id = r.product_id"""

# Withdrawals one after the other: per product the k-th request sees what the earlier ones left.
WITHDRAWALS = """
    select r.request_id, r.product_id, r.quantity, p.quantity as stock,
           row_number() over (partition by r.product_id order by r.request_id) as k
    from stock_requests r left join products p on p.id = r.product_id"""
SERVED = """
    select request_id, product_id, k, coalesce(quantity <= stock, false) as served,
           stock - case when quantity <= stock then quantity else 0 end as remaining
    from withdrawals where k = 1
    union all
    select w.request_id, w.product_id, w.k, coalesce(w.quantity <= s.remaining, false),
           s.remaining - case when w.quantity <= s.remaining then w.quantity else 0 end
    from served s join withdrawals w on w.product_id = s.product_id and w.k = s.k + 1"""

# Checkouts one user after the other, by hash: every step carries the stock left of all products.
CART_LINES = """
    select c.product_id, c.quantity, dense_rank() over (order by md5(cast(c.user_id as varchar)), c.user_id) as turn
    from cart c join products p on p.id = c.product_id"""
CHECKOUT_STEPS = """
    select cast(0 as bigint) as turn, id as product_id, quantity as remaining, 0 as failed from products
    union all
    select turn, product_id, case when failed = 0 then remaining - quantity else remaining end, failed
    from (select s.turn + 1 as turn, s.product_id, s.remaining, coalesce(l.quantity, 0) as quantity,
                 max(case when l.quantity is not null and coalesce(l.quantity > s.remaining, true) then 1 else 0 end)
                   over () as failed
          from checkout_steps s left join cart_lines l on l.turn = s.turn + 1 and l.product_id = s.product_id
          where s.turn < (select max(turn) from cart_lines))"""
CHECKED_OUT = """
    select u.user_id, s.failed
    from (select user_id, row_number() over (order by md5(cast(user_id as varchar)), user_id) as turn
          from (select distinct c.user_id from cart c join products p on p.id = c.product_id)) u
    join (select distinct turn, failed from checkout_steps) s on s.turn = u.turn"""
CHECKOUT = {"cart_lines": CART_LINES, "checkout_steps": CHECKOUT_STEPS, "checked_out": CHECKED_OUT}

RATED = """
    select r.*, not (coalesce(rating, 0) between 1 and 5) or coalesce(purchase_id, 0) = 0
                  or coalesce(product_id, 0) = 0 as invalid,
           r.purchase_id in (select purchase_history_id from product_feedback) as given
    from product_feedback_requests r"""

STATEMENTS = {
    "register_users": on("select * from register_verdicts", registered=REGISTERED, register_verdicts=REGISTER_VERDICTS),
    "register_users_table": on(
        f"""
        select {USER} from users
        union all
        select (select max(id) from users) + row_number() over (order by request_id), username, email, mobile, location,
               role, '2001-07-15 00:00:00'
        from register_verdicts where reason is null""",
        registered=REGISTERED,
        register_verdicts=REGISTER_VERDICTS,
    ),
    "update_users": on(f"""
        select {USER} from users where id not in (select id from user_updates)
        union all
        select u.id, b.username, b.email, b.mobile, b.location, b.role, {ts('u.created_at')}
        from users u join {last("user_updates", "id")} b on b.id = u.id"""),
    "upsert_by_key": on(f"""
        select user_id, product_id, product_name, cast(quantity as bigint) as quantity, cast(price as double) as price,
               cast(discounted_price as double) as discounted_price
        from cart c where not exists (select 1 from cart_upserts b where b.user_id = c.user_id
                                      and b.product_id = c.product_id)
        union all
        select user_id, product_id, product_name, cast(quantity as bigint), cast(price as double),
               cast(discounted_price as double) from {last("cart_upserts", "user_id", "product_id")}"""),
    "create_drives": on(f"""
        select (select max(id) from drives) + row_number() over (order by request_id) as id, request_id, organiser_id,
               event_name, {day('event_date')} as event_date, event_time, latitude, longitude, num_volunteers,
               cast(salary_per_volunteer as double) as salary_per_volunteer, photo_path, supplies, 'Upcoming' as status
        from new_drives"""),
    "update_drives": on("""
        select r.request_id, r.id, r.organiser_id,
               case when exists (select 1 from drives d where d.id = r.id and d.organiser_id = r.organiser_id) then null
                    else 'No event was updated. Please check the event ID.' end as reason
        from drive_updates r"""),
    "update_drives_table": on(f"""
        select d.id, d.organiser_id, coalesce(r.event_name, d.event_name) as event_name,
               {day('coalesce(r.event_date, d.event_date)')} as event_date,
               coalesce(r.event_time, d.event_time) as event_time,
               cast(coalesce(r.num_volunteers, d.num_volunteers) as bigint) as num_volunteers,
               cast(coalesce(r.salary_per_volunteer, d.salary_per_volunteer) as double) as salary_per_volunteer,
               coalesce(r.status, d.status) as status
        from drives d
        left join {last("drive_updates", "id", where=OWN_DRIVE.format(id="drive_updates.id", batch="drive_updates"))} r
          on r.id = d.id"""),
    "delete_drives": kept(f"not coalesce({OWNED}, false)", f"not {CHILD_OWNED}", f"not {CHILD_OWNED}"),
    "delete_drives_any_children": kept(f"not coalesce({OWNED}, false)", f"not {CHILD_ASKED}", f"not {CHILD_ASKED}"),
    "delete_drives_admin": kept("d.id not in (select event_id from drive_deletions)", f"not {CHILD_ASKED}", "true"),
    "delete_users": on("""
        select 'users' as kept_table, id from users where id not in (select user_id from user_deletions)
        union all select 'purchases', id from purchases where user_id not in (select user_id from user_deletions)"""),
    "delete_users_buyers": on("""
        select 'users' as kept_table, id from users
        where not (role = 'buyer' and id in (select user_id from user_deletions))
        union all select 'purchases', id from purchases where user_id not in (select user_id from user_deletions)"""),
    "delete_users_only": on("""
        select 'users' as kept_table, id from users where id not in (select user_id from user_deletions)
        union all select 'purchases', id from purchases"""),
    "review_products": on(f"""
        select p.id, coalesce(b.status, p.status) as status
        from products p left join {last("product_reviews", "id")} b on b.id = p.id"""),
    "join_drives": on(
        """
        select request_id, event_id, volunteer_id,
               case when joined or row_number() over (partition by event_id, volunteer_id order by request_id) > 1
                    then 'You have already joined this event.' end as reason
        from joined_before""",
        joined_before=JOINED,
    ),
    "award_badges": on(
        """
        select request_id, volunteer_id, event_id, badge_type, organiser_id,
               case when missing then 'Missing required data'
                    when awarded or coalesce(min(case when not missing and not awarded and owned then request_id end)
                                     over (partition by volunteer_id, event_id), request_id) < request_id
                      then 'Badge already awarded'
                    when not owned then 'Unauthorized or event not completed' end as reason
        from badge_checks""",
        badge_checks=BADGE_CHECKS,
    ),
    "record_work": on(f"""
        select v.event_id, v.volunteer_id, {ts('v.joined_date')} as joined_date,
               cast(case when b.event_id is null then v.plastics_collected else b.plastics_collected end as double)
                 as plastics_collected,
               cast(coalesce(b.hours_worked, v.hours_worked) as bigint) as hours_worked,
               case when b.event_id is null then v.payment_status else 'Paid' end as payment_status
        from drive_volunteers v left join {LAST_WORK} b on b.event_id = v.event_id and b.volunteer_id = v.volunteer_id"""),
    "record_work_totals": on(f"""
        select v.event_id, cast(coalesce(sum(case when b.event_id is null then v.plastics_collected
                                             else b.plastics_collected end), 0) as double) as total_plastics
        from drive_volunteers v left join {LAST_WORK} b on b.event_id = v.event_id and b.volunteer_id = v.volunteer_id
        group by 1"""),
    "record_products": on("""
        select r.request_id, r.event_id, r.organiser_id, r.products_recycled,
               case when r.products_recycled is null then 'Products recycled value is required'
                    when not exists (select 1 from drives d where d.id = r.event_id and d.organiser_id = r.organiser_id)
                      then 'Event not found or unauthorized' end as reason
        from recycled_records r"""),
    "record_products_table": on(f"""
        select d.id, coalesce(r.products_recycled, d.products_recycled) as products_recycled
        from drives d
        left join {last("recycled_records", "event_id", where="products_recycled is not null and "
                        + OWN_DRIVE.format(id="recycled_records.event_id", batch="recycled_records"))} r
          on r.event_id = d.id"""),
    "upload_products": on(
        """
        select request_id, organiser_id, name, cast(cast(price as decimal(10,2)) as double) as price, description,
               kind as category, case kind when 'wholesale' then 'kg' when 'recycled' then 'units' end as units,
               cast(cast(pieces as decimal(12,2)) as double) as quantity, file_name as image_path,
               coalesce(required,
                 case when listed or coalesce(min(case when required is null and later is null and not listed
                        then request_id end) over (partition by organiser_id, name), request_id) < request_id
                      then 'A product with this name already exists in your inventory' end, later) as reason
        from upload_rules""",
        upload_rows=UPLOAD_ROWS,
        upload_rules=UPLOAD_RULES,
    ),
    "apply_purchases": on(
        """
        select request_id, user_id, product_id, product_name, quantity, cast(price as double) as price,
               case when pct > 0 then cast((cast(price * 100 as bigint) * (100 - pct) + 50) // 100 as double) / 100 end
                 as discounted_price,
               cast((cast(price * 100 as bigint) * (100 - coalesce(pct, 0)) * quantity + 50) // 100 as double) / 100
                 as total_amount,
               from_cart, case when unknown then 'Product not found' when stock is null then 'Stock unknown' end as reason
        from buying""",
        best=BEST,
        pct_of=PCT,
        buying=BUYING,
    ),
    "apply_purchases_stock": on(
        f"""
        select p.id, cast(p.quantity - coalesce(b.taken, 0) as bigint) as quantity
        from products p left join (select product_id, sum(quantity) as taken from {BOUGHT_OK} group by 1) b
          on b.product_id = p.id""",
        best=BEST,
        pct_of=PCT,
        buying=BUYING,
    ),
    "apply_purchases_cart": on(
        f"""
        select c.user_id, c.product_id, c.quantity from cart c
        where not exists (select 1 from {BOUGHT_OK} b where b.from_cart and b.user_id = c.user_id
                          and b.product_id = c.product_id)""",
        best=BEST,
        pct_of=PCT,
        buying=BUYING,
    ),
    "add_to_cart": on(
        """
        select user_id, product_id, asked, cast(added as bigint) as added, name as product_name,
               cast(coalesce(present, 0) + added as bigint) as quantity, cast(price as double) as price,
               cast(offer as double) as discounted_price,
               case when unknown then 'Product not found' when coalesce(stock, 0) <= 0 then 'Product is out of stock'
                    when added < asked then 'Requested quantity exceeds available stock' end as reason
        from adds""",
        adds=ADDS,
    ),
    "add_to_cart_table": on(
        """
        select c.user_id, c.product_id, c.product_name, c.quantity, cast(c.price as double) as price,
               cast(c.discounted_price as double) as discounted_price
        from cart c where not exists (select 1 from adds a where a.added > 0 and a.user_id = c.user_id
                                      and a.product_id = c.product_id)
        union all
        select user_id, product_id, name, cast(coalesce(present, 0) + added as bigint), cast(price as double),
               cast(offer as double) from adds where added > 0""",
        adds=ADDS,
    ),
    "set_cart_quantity": on("select * from set_checks", set_checks=SET_CHECKS),
    "set_cart_quantity_table": on(
        """
        select c.user_id, c.product_id, cast(coalesce(s.quantity, c.quantity) as bigint) as quantity
        from cart c left join set_checks s on s.reason is null and s.user_id = c.user_id and s.product_id = c.product_id""",
        set_checks=SET_CHECKS,
    ),
    "remove_from_cart": on("""
        select c.user_id, c.product_id, c.quantity from cart c
        where not exists (select 1 from cart_removals r where r.user_id = c.user_id and r.product_id = c.product_id)"""),
    "validate_checkout": on("""
        select cart_id, min(line_no) filter (message is not null) is null as success,
               coalesce(arg_min(message, line_no) filter (message is not null), 'Proceeding to checkout') as message
        from (select l.cart_id, l.line_no,
                     case when l.product_id is null or l.quantity is null then 'Invalid cart item structure'
                          when p.id is null then 'Product ID ' || l.product_id || ' does not exist'
                          when p.quantity is null or p.quantity < l.quantity then 'Insufficient stock for ' || p.name
                     end as message
              from checkout_lines l left join products p on p.id = l.product_id)
        group by 1"""),
    "checkout_carts": on(
        "select user_id, case when failed = 1 then 'Insufficient stock' end as reason from checked_out", **CHECKOUT
    ),
    "checkout_purchases": on(
        """
        select c.user_id, c.product_id, c.product_name, cast(coalesce(p.discounted_price, c.price) as double) as price,
               c.quantity, cast(p.discounted_price as double) as discounted_price,
               cast(coalesce(p.discounted_price, c.price) * c.quantity as double) as total_amount,
               '2001-07-15 00:00:00' as purchase_date, 'Completed' as status
        from cart c join products p on p.id = c.product_id join checked_out o on o.user_id = c.user_id and o.failed = 0""",
        **CHECKOUT,
    ),
    "checkout_stock": on(
        """
        select product_id as id, cast(remaining as bigint) as quantity from checkout_steps
        where turn = (select max(turn) from checkout_steps)""",
        **CHECKOUT,
    ),
    "decrement_stock": on(
        """
        select r.request_id, r.product_id, r.quantity, case when not s.served then 'Insufficient quantity' end as reason
        from stock_requests r join served s on s.request_id = r.request_id""",
        withdrawals=WITHDRAWALS,
        served=SERVED,
    ),
    "decrement_stock_table": on(
        """
        select p.id, p.category, cast(coalesce(s.remaining, p.quantity) as bigint) as quantity
        from products p left join (select product_id, arg_max(remaining, k) as remaining from served group by 1) s
          on s.product_id = p.id""",
        withdrawals=WITHDRAWALS,
        served=SERVED,
    ),
    "record_drive_feedback": on("""
        select request_id, event_id, volunteer_id, rating, feedback_text,
               case when rating is null or feedback_text = '' then 'Missing required fields' end as reason
        from drive_feedback_requests"""),
    "record_product_feedback": on(
        """
        select request_id, purchase_id, user_id, product_id, rating, comment,
               case when invalid then 'Invalid data'
                    when given or coalesce(min(case when not invalid and not given then request_id end)
                                             over (partition by purchase_id), request_id) < request_id
                      then 'Feedback already submitted' end as reason
        from rated""",
        rated=RATED,
    ),
    "record_donations": on("""
        select request_id, donor_name, donor_email, donor_phone, cast(amount as double) as amount, organiser_id,
               case when donor_name = '' then 'All fields are required.'
                    when organiser_id is null then 'No organiser selected.' end as reason
        from donation_requests"""),
    "record_donations_table": on(f"""
        select id, donor_name, cast(amount as double) as amount, organiser_id,
               {ts('donation_date')} as donation_date, status from donations
        union all
        select (select max(id) from donations) + row_number() over (order by request_id), donor_name,
               cast(amount as double), organiser_id, '2001-07-15 00:00:00', 'Pending'
        from donation_requests where donor_name <> '' and organiser_id is not null"""),
}
