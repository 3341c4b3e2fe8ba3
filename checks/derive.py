"""Shop tables derived from the driver's tables, in SQL that Spark and DuckDB both accept.

``{time}`` stands for the zone-less timestamp type of each engine. Definitions refer to
earlier ones by name; ``closure`` finds those a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from coursemill import Shop, Store
from coursemill.schema import TABLES
from coursemill.session import ADAPTIVE, COMPRESSED, apply_settings
from coursemill.sources import read_table
from coursemill.store import shared_root

DRIVER_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

EPOCH = "cast('1995-01-01 00:00:00' as {time})"

DEFINITIONS: dict[str, str] = {
    "lms_users": """
        select c_custkey*2 as id, c_name as username,
          concat(lower(replace(c_name,'#','.')),'@example.com') as email, false as is_staff, false as is_superuser
        from customer
        union all
        select s_suppkey*2+1, s_name, concat(lower(replace(s_name,'#','.')),'@example.com'), s_suppkey % 10 = 0, false
        from supplier""",
    "lms_profiles": """
        select id, id as user_id, case when id % 2 = 0 then 'student' else 'teacher' end as role
        from lms_users where id % 100 <> 98""",
    "lms_categories": """
        select cast(row_number() over (order by p_type) as bigint) as id, p_type as name,
          cast(null as varchar(10)) as description, {epoch} as created_at
        from (select distinct p_type from part) t""",
    "lms_courses": """
        select p_partkey as id, concat(p_name,' ',p_brand) as title,
          (p_partkey % (select count(*) from supplier))*2+1 as teacher_id,
          case when p_size>=49 then null else k.id end as category_id,
          cast(floor(p_retailprice) as int) as price, concat(p_type,', "',p_brand,'"') as description,
          cast(null as varchar(10)) as image,
          case when p_size<=16 then 'beginner' when p_size<=33 then 'intermediate' else 'advanced' end as level,
          p_size % 10 <> 0 as is_published, {epoch} as created_at
        from part join lms_categories k on k.name=p_type""",
    "lms_chapters": """
        select id*2+1 as id, id as course_id, 'Chapter 1' as title, concat('Start of ', title) as description,
          cast(1 as bigint) as sort_order, created_at
        from lms_courses
        union all
        select id*2+2, id, 'Chapter 2', cast(null as varchar(10)), cast(2 as bigint), created_at from lms_courses""",
    "lms_lessons": """
        select id, chapter_id, title, case when id % 4 > 0 then concat('Text of ', title, ', "', cast(id as varchar(20)), '"') end as content,
          case id % 7 when 0 then 'not an address' when 1 then '' when 2 then null when 3 then 'https://'
            when 4 then concat('HTTP://video.example.com:80/?v=', cast(id as varchar(20)))
            else concat('https://video.example.com/', cast(id as varchar(20))) end as video_url,
          cast(case when id % 50 = 0 then 0 when chapter_order=1 and sort_order=1 then 15 when chapter_order=1 then 20
            when sort_order=1 then 35 else 40 end as bigint) as duration_minutes,
          sort_order, (chapter_order=1 and sort_order=1) as is_free_preview, created_at
        from (
          select id*2+1 as id, id as chapter_id, concat(cast(sort_order as varchar(20)),'-1') as title,
            sort_order as chapter_order, cast(1 as bigint) as sort_order, created_at from lms_chapters
          union all
          select id*2+2, id, concat(cast(sort_order as varchar(20)),'-2'), sort_order, cast(2 as bigint), created_at
          from lms_chapters) z""",
    "lms_coupons": """
        select cast(id as bigint) as id, code, name, discount_type, cast(discount_value as bigint) as discount_value,
          cast(min_spend as bigint) as min_spend, cast(s as {time}) as start_date, cast(e as {time}) as end_date,
          cast(case when code='SALE20' then (select count(*) from customer) else usage_limit end as bigint) as usage_limit,
          is_active, {epoch} as created_at
        from (values
          (1,'NEW100','n1','amount',100,500,'1995-01-01 00:00:00','2030-01-01 00:00:00',0,true),
          (2,'SALE20','n2','percent',20,950,'1995-01-01 00:00:00','2030-01-01 00:00:00',100,true),
          (3,'OLD50','n3','amount',50,0,'1995-01-01 00:00:00','1996-01-01 00:00:00',0,true),
          (4,'OFF10','n4','percent',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',0,false),
          (5,'FEW15','n5','percent',15,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',50,true),
          (6,'HALF','n6','percent',50,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',30,true),
          (-1,'CHAIN1','k1','amount',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',1,true),
          (-2,'CHAIN2','k2','amount',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',1,true),
          (-3,'CHAIN3','k3','amount',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',1,true),
          (-4,'CHAIN4','k4','amount',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',1,true),
          (-5,'CHAIN5','k5','amount',10,0,'1995-01-01 00:00:00','2030-01-01 00:00:00',1,true)
        ) as t(id,code,name,discount_type,discount_value,min_spend,s,e,usage_limit,is_active)
        union all
        select s_suppkey+7, concat('SUP', cast(s_suppkey as varchar(20))), s_name,
          case when s_suppkey % 2 = 0 then 'amount' else 'percent' end, cast(10 + s_suppkey % 40 as bigint),
          cast(900 + s_suppkey % 100 as bigint), {epoch}, cast('2030-01-01 00:00:00' as {time}),
          cast(case when s_suppkey % 3 = 0 then 0 else 20 end as bigint), s_suppkey % 4 <> 0, {epoch}
        from supplier""",
    "lms_order_items": """
        select l_orderkey*1000000+l_partkey as id, l_orderkey as order_id, l_partkey as course_id,
          cast(c.price as bigint) as price
        from (select distinct l_orderkey, l_partkey from lineitem) l join lms_courses c on c.id=l_partkey""",
    "lms_orders": """
        select id, user_id, course_id, cast(case when disc>0 then coupon_id end as bigint) as coupon_id, original_price,
          disc as discount_amount, original_price-disc as final_price, status, created_at
        from (
          select o_orderkey as id, o_custkey*2 as user_id,
            case when o_orderkey % 20 = 0 then null else f.course_id end as course_id,
            cast(floor(o_totalprice/100) as bigint) as original_price,
            case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 end as coupon_id,
            case when o_orderpriority='1-URGENT' and floor(o_totalprice/100)>=500 then cast(100 as bigint)
              when o_orderpriority='2-HIGH' and floor(o_totalprice/100)>=1000
                then cast(floor(floor(o_totalprice/100)*20/100) as bigint)
              else cast(0 as bigint) end as disc,
            case when o_orderstatus='F' then 'paid' when o_orderstatus='O' then 'pending'
              when o_orderkey % 2 = 0 then 'cancelled' else 'refunded' end as status,
            o_orderdate as created_at
          from orders left join (
            select order_id, min(course_id) as course_id from lms_order_items group by order_id
          ) f on f.order_id=o_orderkey) z""",
    "lms_enrollments": """
        select o.user_id*1000000+i.course_id as id, o.user_id as student_id, i.course_id, min(o.created_at) as purchased_at
        from lms_orders o join lms_order_items i on i.order_id=o.id
        where o.status='paid' group by o.user_id, i.course_id""",
    "lms_payments": """
        select id, id as order_id,
          case id % 5 when 0 then 'credit_card' when 1 then 'atm' when 2 then 'line_pay' when 3 then 'cash' else 'mock' end
            as method,
          final_price as amount, case status when 'cancelled' then 'failed' else status end as status,
          case when id % 5 = 4 then concat('MOCK-', cast(id as varchar(20))) end as transaction_no,
          case when status='paid' then created_at end as paid_at, created_at
        from lms_orders""",
    "lms_coupon_usages": """
        select id, user_id, coupon_id, id as order_id, discount_amount, created_at as used_at
        from lms_orders where coupon_id is not null and status='paid'""",
    "lms_watch_requests": """
        select event_id as id, user_id*2 as user_id,
          case when event_id % 2 = 0 then coalesce(f.c, event_id % (select count(*) from part))
            else event_id % (select count(*) from part) end as course_id,
          ts as watched_at
        from events left join (
          select student_id, min(course_id) as c from lms_enrollments group by student_id
        ) f on f.student_id=user_id*2
        where event_type in ('view','click')""",
    "lms_learning_records": """
        select w.id, w.user_id, w.course_id,
          case when w.id % 10 = 0 then null else w.course_id*4+3+ w.id % 4 end as lesson_id,
          cast(floor(e.value) as bigint) as minutes, w.watched_at
        from lms_watch_requests w join events e on e.event_id=w.id""",
    "lms_review_submissions": """
        select event_id as id, user_id*2 as user_id,
          case when event_id % 2 = 0 then coalesce(f.c, event_id % (select count(*) from part))
            else event_id % (select count(*) from part) end as course_id,
          cast(1+event_id%5 as int) as rating, concat('comment ',cast(event_id as varchar(20))) as comment,
          ts as submitted_at
        from events left join (
          select student_id, min(course_id) as c from lms_enrollments group by student_id
        ) f on f.student_id=user_id*2
        where event_type='purchase'""",
    "lms_reviews": """
        select id, user_id, course_id, rating, comment, created_at, updated_at from (
          select *, row_number() over (partition by user_id, course_id order by submitted_at desc, id desc) as rn,
            min(submitted_at) over (partition by user_id, course_id) as created_at, submitted_at as updated_at
          from lms_review_submissions) z
        where rn=1""",
    "lms_favorites": """
        select min(event_id) as id, user_id*2 as user_id, event_id % (select count(*) from part) as course_id,
          min(ts) as created_at
        from events where event_type='signup' group by 2, 3""",
    "lms_refunds": """
        select id, id as order_id, user_id, final_price as amount, 'reason' as reason,
          case id % 8 when 1 then 'pending' when 3 then 'approved' when 5 then 'rejected' else 'completed' end as status,
          created_at, case when id % 8 = 7 then created_at end as processed_at
        from lms_orders where status='refunded'""",
    "lms_notifications": """
        select o.id, o.user_id, 'purchase ok' as title,
          concat('course ',coalesce(c.title,'-'),', NT$ ',cast(o.final_price as varchar(20))) as content,
          o.id % 3 = 0 as is_read, o.created_at
        from lms_orders o left join lms_courses c on c.id=o.course_id where o.status='paid'""",
    "lms_promotions": """
        select cast(id as bigint) as id, name, cast(null as varchar(10)) as description, discount_type,
          cast(discount_value as bigint) as discount_value, {epoch} as start_date, {epoch} as end_date, is_active,
          {epoch} as created_at
        from (values (1,'promo','percent',15,true),(2,'small','amount',50,false))
          as t(id,name,discount_type,discount_value,is_active)
        union all
        select cast(2 + row_number() over (order by p_brand) as bigint), p_brand, cast(null as varchar(10)), 'percent',
          cast(10 as bigint), {epoch}, {epoch}, p_brand <> 'Brand#11', {epoch}
        from (select distinct p_brand from part) b""",
    "lms_promotion_courses": """
        select cast(1 as bigint) as promotion_id, p_partkey as course_id from part where p_type='PROMO'
        union all select cast(2 as bigint), p_partkey from part where p_size<=5
        union all select b.id, p_partkey from part join lms_promotions b on b.name=p_brand""",
    "lms_user_coupons": """
        select c_custkey as id, c_custkey*2 as user_id, cast(1 as bigint) as coupon_id,
          case c_custkey % 9 when 0 then 'used' when 3 then 'expired' else 'unused' end as status,
          f.first_at as received_at, case c_custkey % 9 when 0 then f.last_at end as used_at
        from customer left join (
          select user_id, min(created_at) as first_at, max(created_at) as last_at from lms_orders group by user_id
        ) f on f.user_id=c_custkey*2
        where c_custkey % 3 = 0""",
    "lms_carts": """
        select c_custkey as id, c_custkey*2 as user_id, f.first_at as created_at, f.last_at as updated_at
        from customer left join (
          select user_id, min(created_at) as first_at, max(created_at) as last_at from lms_orders group by user_id
        ) f on f.user_id=c_custkey*2
        where c_custkey % 4 = 0""",
    "lms_cart_items": """
        select k.id*1000000+i.course_id as id, k.id as cart_id, i.course_id, min(o.created_at) as added_at
        from lms_carts k join lms_orders o on o.user_id=k.user_id and o.status='pending'
          join lms_order_items i on i.order_id=o.id
        group by k.id, i.course_id""",
    "lms_questions": """
        select conv_id as id, (conv_id % (select count(*) from customer))*2 as user_id,
          conv_id % (select count(*) from part) as course_id,
          case when conv_id % 3 = 0 then null else (conv_id % (select count(*) from part))*4+3+ conv_id % 4 end as lesson_id,
          text as title, text as content, o.o_orderdate as created_at
        from conversations left join orders o on o.o_orderkey=conv_id where turn=0""",
    "lms_answers": """
        select min(c.conv_id*1000+c.turn) as id, c.conv_id as question_id, min((q.course_id % (select count(*) from supplier))*2+1) as user_id,
          c.text as content, min(q.created_at) as created_at
        from conversations c join lms_questions q on q.id=c.conv_id where role='assistant' group by c.conv_id, c.text""",
    "lms_audits": """
        select id, id as course_id, case when id % 4 = 1 then (id % (select count(*) from customer))*2 end as reviewer_id,
          case id % 3 when 0 then 'pending' when 1 then 'approved' else 'rejected' end as status,
          case when id % 3 = 2 then concat('see ', title) end as comment, created_at,
          cast(null as {time}) as reviewed_at
        from lms_courses""",
    # ---- request feeds -----------------------------------------------------------------
    "lms_checkout_requests": """
        select o_orderkey as id, o_custkey*2 as user_id, (o_orderkey*31) % (select count(*) from part) as course_id,
          case o_orderpriority when '1-URGENT' then ' new100 ' when '2-HIGH' then 'SALE20' when '3-MEDIUM' then case
            when o_orderkey % 2 = 0 then concat('sup', cast(o_orderkey % (select count(*) from supplier) as varchar(20))) else 'nope' end
            when '5-LOW' then case when o_orderkey % 4 = 1 then 'OLD50' else 'half' end
            else case when o_orderkey % 3 = 1 then '' else 'Few15' end end as coupon_code,
          o_orderdate as requested_at
        from orders
        union all
        -- Buyers without courses, in a row: each loses a coupon's last use to the one before and takes the next one's.
        select -2 * n - step, user_id, cast(1 as bigint), concat('chain', cast(n - 1 + step as varchar(20))),
          case n * 2 + step when 2 then cast('2001-01-01 00:00:02' as {time}) when 3 then cast('2001-01-01 00:00:03' as {time})
            when 4 then cast('2001-01-01 00:00:04' as {time}) when 5 then cast('2001-01-01 00:00:05' as {time})
            when 6 then cast('2001-01-01 00:00:06' as {time}) when 7 then cast('2001-01-01 00:00:07' as {time})
            when 8 then cast('2001-01-01 00:00:08' as {time}) when 9 then cast('2001-01-01 00:00:09' as {time})
            when 10 then cast('2001-01-01 00:00:10' as {time}) else cast('2001-01-01 00:00:11' as {time}) end
        from (
          select user_id, row_number() over (order by user_id) as n from lms_profiles
          where role = 'student' and user_id not in (select student_id from lms_enrollments)
        ) c cross join (select 0 as step union all select 1) s
        where n <= 5 and n - 1 + step >= 1""",
    "lms_purchase_plan": """
        select id*2 as id, user_id, course_id, coupon_id, created_at as requested_at
        from lms_orders where course_id is not null
        union all
        select id*2+1, user_id, (course_id+1) % (select count(*) from part), coupon_id, created_at
        from lms_orders where course_id is not null""",
    "lms_course_forms": """
        select (l_orderkey*1000000+l_partkey)*10000+l_suppkey as id, l_suppkey*2+1 as user_id,
          l_partkey as course_id,
          case when l_partkey % 40 = 7 then '  ' else concat(' edited ', cast(l_partkey as varchar(20)), ' ') end as title,
          cast(500 + min(l_linenumber) as int) as price,
          case when l_orderkey % 50 = 9 then '' else concat('by ', cast(l_suppkey as varchar(20))) end as description,
          case when l_orderkey % 2 = 0 then concat('img/', cast(l_orderkey as varchar(20)), '.png') end as image,
          min(l_shipdate) as submitted_at
        from lineitem group by l_orderkey, l_partkey, l_suppkey""",
    "lms_course_feed": """
        select p_partkey as id,
          case when p_partkey % 2 = 0 then concat(p_name,' ',p_brand) else concat(p_name,' ',p_type) end as title,
          (p_size % (select count(*) from supplier))*2+1 as teacher_id, k.id as category_id,
          cast(floor(p_retailprice)+10 as int) as price, 'advanced' as level, concat('again ', p_brand) as description,
          cast('2002-01-01 00:00:00' as {time}) as created_at
        from part left join lms_categories k on k.name=p_type""",
    "lms_user_feed": """
        select o_orderkey as id,
          case when o_orderkey % 3 = 0 then concat('new.', cast(o_custkey as varchar(20))) else c_name end as username,
          concat('mail', cast(o_orderkey as varchar(20)), case when o_orderkey % 7 = 3 then '' else '@example.com' end)
            as email,
          case when o_orderstatus='F' then 'student' when o_orderstatus='O' then 'teacher' else 'guest' end as role,
          o_orderpriority='1-URGENT' and o_orderkey % 5 = 0 as is_superuser
        from orders join customer on c_custkey=o_custkey""",
    "lms_delete_requests": """
        select a.course_id, c.teacher_id + case when a.id % 9 = 2 then 2 else 0 end as user_id
        from lms_audits a join lms_courses c on c.id=a.course_id where a.status='rejected'""",
    "lms_wanted_promotion_courses": """
        select cast(1 as bigint) as promotion_id, p_partkey as course_id from part where p_type='PROMO' and p_size>10
        union all select cast(2 as bigint), p_partkey from part where p_size between 3 and 8""",
    # ---- tables with faults, for the quality checks ------------------------------------
    "lms_faulty_orders": """
        select o.id, o.user_id, case when r.o_orderkey % 11 = 5 then o.course_id+1000000000 else o.course_id end as course_id,
          o.coupon_id, o.original_price,
          case when r.o_orderpriority='3-MEDIUM' and o.id % 2 = 0 then o.original_price+1 else o.discount_amount end
            as discount_amount,
          case when r.o_orderpriority='4-NOT SPECIFIED' then o.final_price-500 else o.final_price end as final_price,
          case when r.o_orderpriority='5-LOW' then r.o_orderstatus else o.status end as status,
          o.created_at
        from lms_orders o join orders r on r.o_orderkey=o.id""",
    "lms_faulty_users": """
        select o_orderkey as id, case when o_orderkey % 17 = 3 then ' ' when o_orderkey % 19 = 4 then null else c_name end
            as username,
          case when o_orderkey % 7 = 3 then replace(c_name, '#', '@') when o_orderkey % 7 = 4 then ''
            else concat('u', cast(o_orderkey as varchar(20)), '@example.com') end as email,
          false as is_staff, false as is_superuser
        from orders join customer on c_custkey=o_custkey""",
    "lms_faulty_categories": """
        select p_partkey as id, case when p_size % 2 = 0 then lower(p_type) else concat(p_type, ' ', p_brand) end as name
        from part""",
    "lms_faulty_payments": """
        select p.id, p.order_id, case when r.o_orderpriority='1-URGENT' then 'cheque' else p.method end as method,
          case when r.o_orderpriority='2-HIGH' then -1 - p.amount else p.amount end as amount,
          case when p.id % 5 = 2 then concat(p.status, ' as ', r.o_orderpriority) else p.status end as status,
          case when p.id % 6 = 1 then concat(repeat('T', 100), cast(p.id as varchar(20))) else p.transaction_no end
            as transaction_no,
          p.paid_at, case when p.id % 8 = 5 then null else p.created_at end as created_at
        from lms_payments p join orders r on r.o_orderkey=p.id""",
    "lms_repeated_carts": """
        select id, user_id, created_at, updated_at from lms_carts
        union all
        select 1000000000 + o_custkey, o_custkey*2, min(o_orderdate), max(o_orderdate)
        from orders where o_orderstatus='O' group by o_custkey""",
    "lms_repeated_profiles": """
        select id, user_id, role from lms_profiles
        union all
        select 1000000000 + id, id, 'teacher' from lms_users where id % 10 = 4""",
    "lms_repeated_coupon_usages": """
        select id, user_id, coupon_id, order_id, discount_amount, used_at from lms_coupon_usages
        union all
        select 1000000000 + id, user_id, coupon_id, order_id, discount_amount, used_at from lms_coupon_usages
        where id % 3 = 1""",
    "lms_faulty_notifications": """
        select doc.conv_id*1000+doc.turn as id, doc.conv_id*2 as user_id, doc.text as title, doc.text as content,
          false as is_read, cast(null as {time}) as created_at
        from conversations doc""",
}
DEFINITIONS = {
    name: sql.replace("{epoch}", EPOCH) for name, sql in DEFINITIONS.items()
}

#: Parts that Spark gets in another form with the same rows. It would send all rows of ``not in (select ...)`` to the
#: driver, to broadcast them; as a join they stay on the executors. Courses grow with the shop and are joined without a
#: broadcast whatever size Spark takes them for.
SPARK_FORMS: dict[str, tuple[str, str]] = {
    "lms_order_items": (
        "select l_orderkey*1000000+l_partkey as id,",
        "select /*+ merge(c) */ l_orderkey*1000000+l_partkey as id,",
    ),
    "lms_notifications": (
        "select o.id, o.user_id, 'purchase ok' as title,",
        "select /*+ merge(c) */ o.id, o.user_id, 'purchase ok' as title,",
    ),
    "lms_checkout_requests": (
        "from lms_profiles\n          where role = 'student' and user_id not in (select student_id from lms_enrollments)",
        """from lms_profiles p
          where role = 'student' and not exists (select 1 from lms_enrollments e where e.student_id = p.user_id)
            -- A null among the enrolled, or as the user beside any, is neither in nor not in.
            and not exists (select 1 from lms_enrollments where student_id is null)
            and (user_id is not null or not exists (select 1 from lms_enrollments))""",
    ),
}

_NAME = re.compile(r"\blms_\w+")


def closure(sql: str) -> list[str]:
    """Derived tables that ``sql`` needs, each after those it is built on."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in DEFINITIONS and name not in needed:
                visit(DEFINITIONS[name])
                needed.append(name)

    visit(sql)
    return needed


def as_oracle(sql: str) -> str:
    """``sql`` over derived tables as one DuckDB statement over the driver's tables."""
    parts = [f"{name} as ({DEFINITIONS[name]})" for name in closure(sql)]
    text = f"with {', '.join(parts)} select * from ({sql}) answer" if parts else sql
    return text.replace("{time}", "timestamp")


def for_spark(name: str) -> str:
    """The definition of a derived table in the form that Spark gets."""
    sql = DEFINITIONS[name]
    if name in SPARK_FORMS:
        part, form = SPARK_FORMS[name]
        assert part in sql, f"{name} has no such part"
        sql = sql.replace(part, form)
    return sql


#: Of the files of derived tables, which are written once and read by many queries.
COMPRESSION = "zstd"

_written: dict[tuple[str, str], dict[str, tuple[str, StructType]]] = {}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table, written once per session and input folder and read back from there."""
    path, schema = _path(spark, folder, name)
    return spark.read.schema(schema).parquet(path)


def _planned(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table over the written ones it is built on, not written yet."""
    sql = for_spark(name)
    inputs = {}
    for used in dict.fromkeys(re.findall(r"\b(?:lms_\w+|" + "|".join(DRIVER_TABLES) + r")\b", sql)):
        if used in DEFINITIONS:
            inputs[used] = derived(spark, folder, used)
        elif used in DRIVER_TABLES:
            inputs[used] = spark.read.parquet(f"{folder}/{used}.parquet")
    # Name the inputs as spark.sql parameters: from orders -> from {orders}.
    text = re.sub(
        r"\b(from|join)\s+(\w+)",
        lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0],
        sql.replace("{time}", "timestamp_ntz"),
    )
    return spark.sql(text, **inputs)


def _path(spark: SparkSession, folder: str, name: str) -> tuple[str, StructType]:
    """Where a derived table is written, and its columns."""
    paths = _written.setdefault((spark.sparkContext.applicationId, folder), {})
    if name not in paths:
        apply_settings(spark, COMPRESSED)
        df = _planned(spark, folder, name)
        path = Store(spark, f"{shared_root(spark)}/derived").fresh_path(name)
        df.write.option("compression", COMPRESSION).parquet(path)
        paths[name] = path, df.schema
    return paths[name]


def shop_from(spark: SparkSession, folder: str) -> Shop:
    """The shop over the driver's tables in ``folder``, read back in its declared columns."""
    apply_settings(spark, {**ADAPTIVE, **COMPRESSED})
    return Shop(lambda name: read_table(spark, name, _path(spark, folder, f"lms_{name}")[0]), tuple(TABLES))
