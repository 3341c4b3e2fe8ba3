"""DuckDB SQL for the registered queries, written against the derived shop tables."""

from __future__ import annotations

from .derive import as_oracle



def _avg1(total: str, n: str) -> str:
    return f"case when {n} > 0 then cast(printf('%.1f', round(cast({total} as double) / {n}, 4)) as double) end"


def _case(column: str, labels: dict[str, str]) -> str:
    whens = " ".join(f"when '{code}' then '{label}'" for code, label in labels.items())
    return f"case {column} {whens} else {column} end"


# Code labels.
ROLE = {"student": "學生", "teacher": "老師"}
LEVEL = {"beginner": "初階", "intermediate": "中階", "advanced": "高階"}
KIND = {"amount": "固定金額折扣", "percent": "百分比折扣"}
USER_COUPON = {"unused": "未使用", "used": "已使用", "expired": "已過期"}
ORDER = {"pending": "待付款", "paid": "已付款", "cancelled": "已取消", "refunded": "已退款"}
METHOD = {"credit_card": "信用卡", "atm": "ATM轉帳", "line_pay": "LINE Pay", "cash": "現金", "mock": "模擬付款"}
PAYMENT = {"pending": "待付款", "paid": "付款成功", "failed": "付款失敗", "refunded": "已退款"}
REFUND = {"pending": "退款審核中", "approved": "退款通過", "rejected": "退款拒絕", "completed": "退款完成"}
AUDIT = {"pending": "待審核", "approved": "審核通過", "rejected": "審核退回"}

TABLES = (
    "users profiles categories courses chapters lessons enrollments learning_records coupons user_coupons promotions "
    "promotion_courses carts cart_items orders order_items coupon_usages payments refunds favorites reviews "
    "notifications questions answers audits"
).split()

# One label per row of each table: (from clause, label).
_U = "join lms_users u on u.id=t.user_id"
_C = "join lms_courses c on c.id=t.course_id"
LABELS = {
    "users": ("lms_users t", "t.username"),
    "profiles": (f"lms_profiles t {_U}", f"u.username || ' - ' || {_case('t.role', ROLE)}"),
    "categories": ("lms_categories t", "t.name"),
    "courses": ("lms_courses t", "t.title"),
    "chapters": (f"lms_chapters t {_C}", "c.title || ' - ' || t.title"),
    "lessons": ("lms_lessons t join lms_chapters h on h.id=t.chapter_id", "h.title || ' - ' || t.title"),
    "enrollments": (
        f"lms_enrollments t join lms_users u on u.id=t.student_id {_C}",
        "u.username || ' - ' || c.title",
    ),
    "learning_records": (
        f"lms_learning_records t {_U} {_C}",
        "u.username || ' - ' || c.title || ' - ' || t.minutes || ' 分鐘'",
    ),
    "coupons": ("lms_coupons t", "t.code || ' - ' || t.name"),
    "user_coupons": (
        f"lms_user_coupons t {_U} join lms_coupons k on k.id=t.coupon_id",
        f"u.username || ' - ' || k.code || ' - ' || {_case('t.status', USER_COUPON)}",
    ),
    "promotions": ("lms_promotions t", "t.name"),
    "carts": (f"lms_carts t {_U}", "u.username || ' 的購物車'"),
    "cart_items": (
        f"lms_cart_items t join lms_carts k on k.id=t.cart_id join lms_users u on u.id=k.user_id {_C}",
        "u.username || ' - ' || c.title",
    ),
    "orders": (
        f"lms_orders t {_U} left {_C}",
        "u.username || ' - ' || coalesce(c.title, '多課程訂單') || ' - NT$ ' || t.final_price",
    ),
    "order_items": (f"lms_order_items t {_C}", "t.order_id || ' - ' || c.title"),
    "coupon_usages": (
        f"lms_coupon_usages t {_U} join lms_coupons k on k.id=t.coupon_id",
        "u.username || ' 使用 ' || k.code",
    ),
    "payments": (
        "lms_payments t",
        f"'訂單 ' || t.order_id || ' - NT$ ' || t.amount || ' - ' || {_case('t.status', PAYMENT)}",
    ),
    "refunds": (
        f"lms_refunds t {_U}",
        f"u.username || ' - 訂單 ' || t.order_id || ' - ' || {_case('t.status', REFUND)}",
    ),
    "favorites": (f"lms_favorites t {_U} {_C}", "u.username || ' 收藏 ' || c.title"),
    "reviews": (
        f"lms_reviews t {_U} {_C}",
        "u.username || ' - ' || c.title || ' - ' || t.rating || ' 星'",
    ),
    "notifications": (f"lms_notifications t {_U}", "u.username || ' - ' || t.title"),
    "questions": (f"lms_questions t {_C}", "c.title || ' - ' || t.title"),
    "answers": (
        f"lms_answers t join lms_questions q on q.id=t.question_id {_U}",
        "q.title || ' - ' || u.username",
    ),
    "audits": (f"lms_audits t {_C}", f"c.title || ' - ' || {_case('t.status', AUDIT)}"),
}


def _label(table: str, key: str) -> str:
    source, text = LABELS[table]
    return f"(select {text} from {source} where t.id = x.{key})"


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


# --- figures ----------------------------------------------------------------------------
_FACTS = """
    left join (select course_id, count(*) n from lms_enrollments group by 1) e on e.course_id=c.id
    left join (select course_id, cast(sum(minutes) as bigint) n from lms_learning_records group by 1) w on w.course_id=c.id
    left join (select course_id, cast(sum(final_price) as bigint) n from lms_orders where status='paid' group by 1) o
      on o.course_id=c.id
    left join (select course_id, cast(sum(rating) as bigint) s, count(*) n from lms_reviews group by 1) r
      on r.course_id=c.id"""

_BY_TITLE = """
    select user_id, title, cast(sum(minutes) as bigint) as total
    from lms_learning_records l join lms_courses c on c.id=l.course_id group by 1, 2"""

_SERIES = f"""
    select c.teacher_id, c.id as course_id, c.title, coalesce(e.n,0) as purchase_count, coalesce(o.n,0) as revenue,
      coalesce(w.n,0) as watch_minutes, coalesce({_avg1('r.s', 'r.n')}, 0.0) as rating
    from lms_courses c {_FACTS}"""

def _student_chart(points: int) -> str:
    return f"""
        select user_id, cast(floor((p-1)/{points}) as int) as part,
          '[' || string_agg(cast(to_json(title) as varchar), ', ' order by p) || ']' as course_labels_json,
          '[' || string_agg(cast(total as varchar), ', ' order by p) || ']' as course_minutes_json
        from (select *, row_number() over (partition by user_id order by total desc, title) as p from ({_BY_TITLE}) y) z
        group by 1, 2"""


def _teacher_chart(points: int) -> str:
    return f"""
        select teacher_id, cast(floor((p-1)/{points}) as int) as part,
          '[' || string_agg(cast(to_json(title) as varchar), ', ' order by p) || ']' as course_labels_json,
          '[' || string_agg(cast(purchase_count as varchar), ', ' order by p) || ']' as purchase_counts_json,
          '[' || string_agg(cast(revenue as varchar), ', ' order by p) || ']' as revenue_data_json,
          '[' || string_agg(cast(watch_minutes as varchar), ', ' order by p) || ']' as watch_minutes_data_json,
          '[' || string_agg(case when rating=0 then '0' else cast(rating as varchar) end, ', ' order by p) || ']'
            as rating_data_json
        from (select *, row_number() over (partition by teacher_id order by course_id) as p from ({_SERIES}) y) z
        group by 1, 2"""


METRICS = {
    "course_scorecard": f"""
        select c.id as course_id, c.title, c.teacher_id, c.price, coalesce(e.n,0) as purchase_count,
          coalesce(w.n,0) as total_watch_minutes, coalesce(o.n,0) as total_revenue,
          {_avg1('r.s', 'r.n')} as average_rating
        from lms_courses c {_FACTS}""",
    "teacher_course_series": _SERIES,
    "teacher_totals": f"""
        select p.user_id as teacher_id, cast(coalesce(sum(o.n),0) as bigint) as total_revenue,
          cast(coalesce(sum(e.n),0) as bigint) as total_purchase_count,
          cast(coalesce(sum(w.n),0) as bigint) as total_watch_minutes
        from lms_profiles p left join lms_courses c on c.teacher_id=p.user_id {_FACTS}
        where p.role='teacher' group by 1""",
    "student_kpis": """
        select p.user_id, p.role, cast(coalesce(m.n,0) as bigint) as total_minutes, coalesce(e.n,0) as purchased_count
        from lms_profiles p
        left join (select user_id, sum(minutes) n from lms_learning_records group by 1) m on m.user_id=p.user_id
        left join (select student_id, count(*) n from lms_enrollments group by 1) e on e.student_id=p.user_id""",
    "student_minutes_by_title": _BY_TITLE,
    "student_minutes_share": f"""
        select user_id, title, total,
          cast(total as double) / nullif(cast(sum(total) over (partition by user_id) as double), 0) as share
        from ({_BY_TITLE}) z""",
    "course_rating_summary": f"""
        select c.id as course_id, avg(v.rating) as raw_average,
          {_avg1('sum(v.rating)', 'count(v.rating)')} as average_rating, count(v.rating) as review_count
        from lms_courses c left join lms_reviews v on v.course_id=c.id group by 1""",
    "my_courses": """
        select e.id as enrollment_id, e.student_id as user_id, e.course_id, c.title as course_title, c.description,
          u.username as teacher_username, k.name as category, e.purchased_at,
          cast(coalesce((select sum(minutes) from lms_learning_records l
            where l.user_id=e.student_id and l.course_id=e.course_id),0) as bigint) as watch_minutes,
          cast(coalesce((select sum(minutes) from lms_learning_records l where l.user_id=e.student_id),0) as bigint)
            as total_minutes
        from lms_enrollments e join lms_courses c on c.id=e.course_id join lms_users u on u.id=c.teacher_id
        left join lms_categories k on k.id=c.category_id
        where exists (select 1 from lms_profiles p where p.user_id=e.student_id)""",
    "coupon_usage_counts": """
        select k.id as coupon_id, k.code, count(s.id) as used_count
        from lms_coupons k left join lms_coupon_usages s on s.coupon_id=k.id group by 1, 2""",
    "recent_learning": """
        select l.id as record_id, l.user_id, l.position, c.title as course_title, s.title as lesson_title, l.minutes,
          l.watched_at
        from (select *, cast(row_number() over (partition by user_id order by watched_at desc, id desc) as int) as position
          from lms_learning_records) l
        join lms_courses c on c.id=l.course_id left join lms_lessons s on s.id=l.lesson_id
        where l.position <= 10""",
    "rating_rounding": f"""
        select grouped_by, group_id, total, n, {_avg1('total', 'n')} as average from (
          select 'course_id' as grouped_by, course_id as group_id, cast(sum(rating) as bigint) as total, count(*) as n
          from lms_reviews group by 2
          union all select 'user_id', user_id, cast(sum(rating) as bigint), count(*) from lms_reviews group by 2
          union all select 'minutes', course_id, cast(sum(minutes) as bigint), 20 from lms_learning_records group by 2
        ) z""",
    # Points per row is 1000, so the positions are cut into parts of that size.
    "student_chart_json": _student_chart(1000),
    "student_chart_parts": _student_chart(2),
    "teacher_chart_json": _teacher_chart(1000),
    "teacher_chart_parts": _teacher_chart(3),
}

# --- catalogue and course pages ---------------------------------------------------------
_CARDS = """lms_courses c join lms_users u on u.id=c.teacher_id left join lms_categories k on k.id=c.category_id
    where c.is_published"""

def _curriculum(lessons: int) -> str:
    return f"""
        select course_id, chapter_order, chapter_id, chapter_title, cast(floor((p-1)/{lessons}) as int) as part,
          '[' || coalesce(string_agg(lesson, ',' order by p), '') || ']' as lessons
        from (
          select *, case when lesson_id is not null then '{{"position":' || p || ',"lesson_id":' || lesson_id || ',"label":'
            || cast(to_json(label) as varchar) || ',"duration_minutes":' || duration_minutes || ',"is_free_preview":'
            || is_free_preview || '}}' end as lesson
          from (
            select h.course_id, h.id as chapter_id, h.title as chapter_title, h.sort_order as chapter_order,
              s.id as lesson_id, h.sort_order || '-' || s.sort_order || ' ' || s.title as label,
              s.duration_minutes, s.is_free_preview,
              row_number() over (partition by h.id order by s.sort_order, s.id) as p
            from lms_chapters h left join lms_lessons s on s.chapter_id=h.id) a) b
        group by 1, 2, 3, 4, 5"""


CATALOG = {
    "source_column_counts": _union(
        [
            f"select '{t}' as table_name, column_name, n_values from ("
            f"unpivot (select count(COLUMNS(*)) as '\\0' from lms_{t}) on * into name column_name value n_values) u"
            for t in TABLES
        ]
    ),
    "source_row_counts": _union([f"select '{t}' as table_name, count(*) as n from lms_{t}" for t in TABLES]),
    "catalog": f"""
        select c.id as course_id, c.title, {_case('c.level', LEVEL)} as level_label, k.name as category, c.description,
          u.username, c.price, substring(c.title,1,1) as title_initial, upper(substring(u.username,1,1)) as teacher_initial
        from {_CARDS}""",
    "catalog_count": "select count(*) as n_courses from lms_courses where is_published",
    "catalog_search": f"""
        select c.id as course_id, c.title, u.username, coalesce(k.name,'未分類') as category from {_CARDS}
        and (contains(lower(c.title),'gear brand#1') or contains(lower(u.username),'gear brand#1'))""",
    "catalog_by_category": f"""
        select c.id as course_id, c.title, u.username, coalesce(k.name,'未分類') as category from {_CARDS}
        and k.name is null and (contains(lower(c.title),'supplier') or contains(lower(u.username),'supplier'))""",
    "catalog_facets": """
        select distinct k.name as category from lms_courses c join lms_categories k on k.id=c.category_id
        where c.is_published""",
    "course_by_id": """
        select w.id as request_id, w.id as course_id, c.id is not null as found, c.title, c.price, c.is_published
        from lms_watch_requests w left join lms_courses c on c.id=w.id""",
    "teacher_owned_courses": """
        select distinct f.course_id, f.user_id, c.title
        from lms_course_forms f join lms_courses c on c.id=f.course_id and c.teacher_id=f.user_id""",
    "purchase_flags": """
        select w.id as visit_id, w.user_id, w.course_id, e.id is not null as already_purchased,
          case when e.id is not null then v.rating end as my_rating
        from lms_watch_requests w
        left join lms_enrollments e on e.student_id=w.user_id and e.course_id=w.course_id
        left join lms_reviews v on v.user_id=w.user_id and v.course_id=w.course_id""",
    "course_reviews": """
        select v.id as review_id, v.course_id, u.username, v.rating, v.comment, v.created_at
        from lms_reviews v join lms_users u on u.id=v.user_id""",
    "curriculum": _curriculum(500),
    "curriculum_parts": _curriculum(1),
    "curriculum_flat": """
        select h.course_id, h.id as chapter_id, h.title as chapter_title, h.sort_order as chapter_order,
          s.id as lesson_id, s.sort_order as lesson_order, h.sort_order || '-' || s.sort_order || ' ' || s.title as label,
          s.duration_minutes, s.is_free_preview
        from lms_chapters h left join lms_lessons s on s.chapter_id=h.id""",
    "promotion_coverage": """
        select p.id as promotion_id, p.name as promotion, count(c.id) as n_courses,
          cast(coalesce(sum(c.price),0) as bigint) as list_price
        from lms_promotions p left join lms_promotion_courses b on b.promotion_id=p.id
        left join lms_courses c on c.id=b.course_id group by 1, 2""",
    "users_with_role": """
        select u.id as user_id, u.username, u.email, p.role, p.id is not null as has_profile
        from lms_users u left join lms_profiles p on p.user_id=u.id""",
    "order_receipt": """
        select o.id as order_id, o.user_id, c.title as course_title, o.original_price, o.discount_amount, o.final_price,
          k.code as coupon_code
        from lms_orders o left join lms_courses c on c.id=o.course_id left join lms_coupons k on k.id=o.coupon_id""",
    "choice_labels": _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, {c} as code, {_case(c, labels)} as label, count(*) as n_rows "
            f"from lms_{t} group by {c}"
            for t, c, labels in (
                ("profiles", "role", ROLE),
                ("courses", "level", LEVEL),
                ("coupons", "discount_type", KIND),
                ("user_coupons", "status", USER_COUPON),
                ("promotions", "discount_type", KIND),
                ("orders", "status", ORDER),
                ("payments", "method", METHOD),
                ("payments", "status", PAYMENT),
                ("refunds", "status", REFUND),
                ("audits", "status", AUDIT),
            )
        ]
    ),
    "row_labels": _union(
        [
            f"select '{t}' as table_name, t.id, {text} as label from {source}"
            for t, (source, text) in LABELS.items()
            if t != "users"
        ]
    ),
}

# --- exports ----------------------------------------------------------------------------
_TEACHER = "join lms_courses c on c.id=t.course_id join lms_users w on w.id=c.teacher_id"

EXPORTS = {
    "export_courses": f"""
        select t.id as course_id, t.title as course_title, u.username as teacher_username, u.email as teacher_email,
          coalesce(k.name,'') as category, {_case('t.level', LEVEL)} as level, t.price, t.description, t.is_published,
          t.created_at
        from lms_courses t join lms_users u on u.id=t.teacher_id left join lms_categories k on k.id=t.category_id""",
    "export_enrollments": f"""
        select t.id as enrollment_id, u.username as student_username, u.email as student_email, t.course_id,
          c.title as course_title, w.username as teacher_username, t.purchased_at
        from lms_enrollments t join lms_users u on u.id=t.student_id {_TEACHER}""",
    "export_learning_records": f"""
        select t.id as record_id, u.username, u.email, t.course_id, c.title as course_title,
          w.username as teacher_username, coalesce(s.title,'') as lesson_title, t.minutes, t.watched_at
        from lms_learning_records t join lms_users u on u.id=t.user_id {_TEACHER}
        left join lms_lessons s on s.id=t.lesson_id""",
    "export_profiles": f"""
        select t.id as profile_id, u.username, u.email, t.role, {_case('t.role', ROLE)} as role_display
        from lms_profiles t join lms_users u on u.id=t.user_id""",
    "export_orders": """
        select t.id as order_id, u.username, u.email, coalesce(cast(c.id as varchar),'') as course_id,
          coalesce(c.title,'') as course_title, coalesce(k.code,'') as coupon_code, t.original_price, t.discount_amount,
          t.final_price, t.status, t.created_at
        from lms_orders t join lms_users u on u.id=t.user_id left join lms_courses c on c.id=t.course_id
        left join lms_coupons k on k.id=t.coupon_id""",
    "export_order_items": f"""
        select t.id as order_item_id, t.order_id, u.username, t.course_id, c.title as course_title,
          w.username as teacher_username, t.price
        from lms_order_items t join lms_orders o on o.id=t.order_id join lms_users u on u.id=o.user_id {_TEACHER}""",
    "export_payments": """
        select t.id as payment_id, t.order_id, u.username, t.method, t.amount, t.status, t.transaction_no, t.paid_at,
          t.created_at
        from lms_payments t join lms_orders o on o.id=t.order_id join lms_users u on u.id=o.user_id""",
    "export_coupon_usage": """
        select t.id as coupon_usage_id, u.username, k.code as coupon_code, k.name as coupon_name, t.order_id,
          t.discount_amount, t.used_at
        from lms_coupon_usages t join lms_users u on u.id=t.user_id join lms_coupons k on k.id=t.coupon_id""",
    "export_reviews": f"""
        select t.id as review_id, u.username, u.email, t.course_id, c.title as course_title,
          w.username as teacher_username, t.rating, t.comment, t.created_at, t.updated_at
        from lms_reviews t join lms_users u on u.id=t.user_id {_TEACHER}""",
    "export_course_lessons": """
        select t.id as lesson_id, h.course_id, c.title as course_title, h.id as chapter_id, h.title as chapter_title,
          t.title as lesson_title, t.duration_minutes, t.is_free_preview, t.sort_order, t.created_at
        from lms_lessons t join lms_chapters h on h.id=t.chapter_id join lms_courses c on c.id=h.course_id""",
}
EXPORTS["export_row_counts"] = _union(
    [
        f"select '{name}' as export, count(*) as n_rows from lms_{table}"
        for name, table in (
            ("courses", "courses"),
            ("enrollments", "enrollments"),
            ("learning_records", "learning_records"),
            ("profiles", "profiles"),
            ("orders", "orders"),
            ("order_items", "order_items"),
            ("payments", "payments"),
            ("coupon_usage", "coupon_usages"),
            ("reviews", "reviews"),
            ("course_lessons", "lessons"),
        )
    ]
)
EXPORTS["export_csv_files"] = EXPORTS["export_row_counts"]

# A cell as text: True/False, UTC times with six decimals unless they are zero, '' for null.
_CELL = """coalesce(case typeof(COLUMNS(*))
    when 'BOOLEAN' then case cast(COLUMNS(*) as varchar) when 'true' then 'True' when 'false' then 'False' end
    when 'TIMESTAMP' then case when contains(cast(COLUMNS(*) as varchar), '.') then rpad(cast(COLUMNS(*) as varchar), 26, '0')
      else cast(COLUMNS(*) as varchar) end || '+00:00'
    else cast(COLUMNS(*) as varchar) end, '')"""
for _name in [name for name in EXPORTS if name not in ("export_row_counts", "export_csv_files")]:
    EXPORTS[_name.replace("export_", "csv_", 1)] = f"select {_CELL} from ({EXPORTS[_name]}) cells"


def _fresh(table: str, order: str) -> str:
    """Ids of new rows: the table's highest plus the number in ``order``."""
    return f"cast((select coalesce(max(id),0) from lms_{table}) + row_number() over (order by {order}) as bigint)"


# --- checkout ---------------------------------------------------------------------------
_GIVEN = """case when {price} < {k}.min_spend then 0 when {k}.discount_type='amount'
    then least({k}.discount_value, {price}) when {k}.discount_type='percent'
    then least({price}*{k}.discount_value // 100, {price}) else 0 end"""


def _priced(requests: str, uses: str) -> str:
    given = _GIVEN.format(price="cast(c.price as bigint)", k="k")
    return f"""
      select id, user_id, course_id, case when outcome='ok' then k_id end as coupon_id, requested_at, price,
        case when outcome='ok' and k_id is not null then given else 0 end as discount,
        price - case when outcome='ok' and k_id is not null then given else 0 end as final, outcome
      from (
        select r.id, r.user_id, r.course_id, k.id as k_id, r.requested_at, cast(c.price as bigint) as price,
          cast({given} as bigint) as given,
          case when trim(r.coupon_code)='' then 'ok' when k.id is null then 'coupon_not_found'
            when not k.is_active or k.start_date > r.requested_at or k.end_date < r.requested_at
              or (k.usage_limit > 0 and (select count(*) from {uses} s where s.coupon_id=k.id) >= k.usage_limit)
              then 'coupon_not_usable'
            when {given} <= 0 then 'coupon_no_discount' else 'ok' end as outcome
        from {requests} r join lms_courses c on c.id=r.course_id
        left join lms_coupons k on lower(k.code)=lower(trim(r.coupon_code))) z"""


_ELIGIBLE = """
    select * from lms_checkout_requests r
    where exists (select 1 from lms_profiles p where p.user_id=r.user_id)
      and not exists (select 1 from lms_enrollments e where e.student_id=r.user_id and e.course_id=r.course_id)"""

def _first(rows: str) -> str:
    return f"""select id, user_id, course_id, coupon_id, requested_at, price, discount, final from (
        select *, row_number() over (partition by user_id, course_id order by requested_at, id) as pick from ({rows}) a
      ) b where pick=1"""


def _accepted(uses: str, rounds: int = 12) -> str:
    """Serving in order, as the limit of repeated cut-offs; the last of ``rounds`` must move none."""
    parts = [
        f"eligible as ({_ELIGIBLE})",
        f"good as materialized (select * from ({_priced('eligible', uses)}) p where outcome='ok')",
        f"room as (select id as coupon_id, usage_limit - (select count(*) from {uses} s where s.coupon_id=k.id) as n "
        "from lms_coupons k where usage_limit > 0)",
        f"won0 as materialized ({_first('select * from good')})",
    ]
    for i in range(1, rounds + 1):
        ranked = (
            f"select w.*, room.n, row_number() over (partition by w.coupon_id order by requested_at, w.id) as k "
            f"from won{i-1} w join room on room.coupon_id=w.coupon_id"
        )
        parts.append(f"cut{i} as (select coupon_id, requested_at as at, id as last from ({ranked}) q where k=n)")
        kept = (
            f"select g.* from good g left join cut{i} c on c.coupon_id=g.coupon_id where c.last is null "
            "or g.requested_at < c.at or (g.requested_at = c.at and g.id <= c.last)"
        )
        parts.append(f"won{i} as materialized ({_first(kept)})")
    moved = f"(select * from cut{rounds} except select * from cut{rounds-1})"
    at_rest = f"case when exists {moved} then error('the cut-offs still move') else true end"
    return f"with {', '.join(parts)} select * from won{rounds} where {at_rest}"


_ACCEPTED = _accepted("lms_coupon_usages")
_NUMBERED = f"(select *, row_number() over (order by requested_at, id) as number from ({_ACCEPTED}) y)"


def _next(table: str) -> str:
    return f"(select coalesce(max(id),0) from lms_{table}) + number"


_PLANNED = f"""
    select * from (
      select p.id, p.user_id, p.course_id, p.coupon_id, p.requested_at, cast(c.price as bigint) as price,
        case when k.id is null then 0 else cast({_GIVEN.format(price='cast(c.price as bigint)', k='k')} as bigint) end as given,
        row_number() over (partition by p.user_id, p.course_id order by p.requested_at, p.id) as pick
      from lms_purchase_plan p join lms_courses c on c.id=p.course_id left join lms_coupons k on k.id=p.coupon_id) z
    where pick=1"""

CHECKOUT = {
    "coupon_discount": f"""
        select o.id as order_id, c.price, cast({_GIVEN.format(price='cast(c.price as bigint)', k='k')} as bigint) as discount
        from lms_orders o join lms_coupons k on k.id=o.coupon_id join lms_courses c on c.id=o.course_id""",
    "coupon_validity": """
        select k.id as coupon_id, k.code, u.n as used_count,
          k.is_active and timestamp '2000-06-15 12:00:00' between k.start_date and k.end_date
            and (k.usage_limit=0 or u.n < k.usage_limit) as usable
        from lms_coupons k join (
          select b.id, count(s.id) as n from lms_coupons b left join lms_coupon_usages s on s.coupon_id=b.id group by 1
        ) u on u.id=k.id""",
    "price_checkout": _priced("lms_checkout_requests", "lms_coupon_usages"),
    "checkout_eligible": _ELIGIBLE,
    "checkout_accepted": _ACCEPTED,
    "planned_orders": f"""
        select {_fresh('orders', 'requested_at, p.id')} as id, user_id, course_id, coupon_id, price as original_price,
          given as discount_amount, price - given as final_price, 'paid' as status, requested_at as created_at
        from ({_PLANNED}) p
        where not exists (select 1 from lms_orders o where o.user_id=p.user_id and o.course_id=p.course_id)""",
    "planned_enrollments": f"""
        select {_fresh('enrollments', 'requested_at, p.id')} as id, user_id as student_id, course_id,
          requested_at as purchased_at
        from ({_PLANNED}) p
        where not exists (select 1 from lms_enrollments e where e.student_id=p.user_id and e.course_id=p.course_id)""",
    "checkout_orders": f"""
        select {_next('orders')} as id, user_id, course_id, coupon_id, price as original_price,
          discount as discount_amount, final as final_price, 'paid' as status, requested_at as created_at
        from {_NUMBERED} n""",
    "checkout_order_items": f"""
        select {_next('order_items')} as id, {_next('orders')} as order_id, course_id, price from {_NUMBERED} n""",
    "checkout_payments": f"""
        select {_next('payments')} as id, {_next('orders')} as order_id, 'mock' as method, final as amount,
          'paid' as status, printf('MOCK-%05d', {_next('orders')}) as transaction_no, requested_at as paid_at,
          requested_at as created_at
        from {_NUMBERED} n""",
    "checkout_enrollments": f"""
        select id, student_id, course_id, purchased_at from lms_enrollments
        union all
        select {_fresh('enrollments', 'requested_at, n.id')}, user_id, course_id, requested_at from {_NUMBERED} n""",
    "checkout_coupon_usages": f"""
        select {_next('coupon_usages')} as id, user_id, coupon_id, {_next('orders')} as order_id,
          discount as discount_amount, requested_at as used_at
        from {_NUMBERED} n where coupon_id is not null""",
    "checkout_notifications": f"""
        select {_next('notifications')} as id, n.user_id, '購買成功通知' as title,
          '你已成功購買「' || c.title || '」，實付金額 NT$ ' || n.final || '。' as content, false as is_read,
          n.requested_at as created_at
        from (select *, number as k from {_NUMBERED} m) n join lms_courses c on c.id=n.course_id""".replace(
        "(select coalesce(max(id),0) from lms_notifications) + number",
        "(select coalesce(max(id),0) from lms_notifications) + n.number",
    ),
}

# --- other write paths ------------------------------------------------------------------
_REVIEWS_AFTER = f"""
    with sent as (
      select *, row_number() over (partition by user_id, course_id order by submitted_at, id) as first,
        row_number() over (partition by user_id, course_id order by submitted_at desc, id desc) as last
      from lms_review_submissions s
      where exists (select 1 from lms_enrollments e where e.student_id=s.user_id and e.course_id=s.course_id)),
    merged as (
      select a.user_id, a.course_id, b.rating, b.comment, a.submitted_at as created_at, b.submitted_at as updated_at,
        a.id as first_id
      from sent a join sent b on b.user_id=a.user_id and b.course_id=a.course_id where a.first=1 and b.last=1)
    select r.id, r.user_id, r.course_id, coalesce(m.rating, r.rating) as rating,
      case when m.first_id is null then r.comment else m.comment end as comment, r.created_at,
      coalesce(m.updated_at, r.updated_at) as updated_at
    from lms_reviews r left join merged m on m.user_id=r.user_id and m.course_id=r.course_id
    union all
    select {_fresh('reviews', 'created_at, first_id')}, user_id, course_id, rating, comment, created_at, updated_at
    from merged m
    where not exists (select 1 from lms_reviews r where r.user_id=m.user_id and r.course_id=m.course_id)"""

_WATCHED = """
    select {id} as id, w.user_id, w.course_id, cast(null as bigint) as lesson_id, cast(30 as bigint) as minutes, w.watched_at
    from lms_watch_requests w
    where exists (select 1 from lms_enrollments e where e.student_id=w.user_id and e.course_id=w.course_id)"""

_FORMS = """
    select f.id, f.user_id, f.course_id, trim(f.title) as title, f.price, trim(f.description) as description, f.image,
      f.submitted_at
    from lms_course_forms f join lms_profiles p on p.user_id=f.user_id and p.role='teacher'
    where trim(f.title) <> '' and length(trim(f.title)) <= 200 and trim(f.description) <> ''"""

_SIGN_UPS = """
    select id, username, email, role from (
      select *, row_number() over (partition by username order by id) as pick from lms_user_feed
      where regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') and role in ('student','teacher')) z
    where pick=1 and not exists (select 1 from lms_users u where u.username=z.username)"""

WRITES = {
    "review_upsert": _REVIEWS_AFTER,
    "watch_log": _WATCHED.format(id=_fresh("learning_records", "w.watched_at, w.id")),
    "starter_lessons": """
        select e.student_id as user_id, e.course_id, s.lesson_id,
          cast(case when s.duration_minutes > 0 then s.duration_minutes else 30 end as bigint) as minutes,
          e.purchased_at as watched_at
        from lms_enrollments e join (
          select h.course_id, l.id as lesson_id, l.duration_minutes,
            row_number() over (partition by h.course_id order by h.sort_order, l.sort_order, l.id) as k
          from lms_lessons l join lms_chapters h on h.id=l.chapter_id) s on s.course_id=e.course_id and s.k <= 2
        where not exists (select 1 from lms_learning_records r
          where r.user_id=e.student_id and r.course_id=e.course_id and r.lesson_id=s.lesson_id)""",
    "insert_if_absent": f"""
        select id, user_id, course_id, created_at from lms_favorites
        union all
        select {_fresh('favorites', 'watched_at, id')}, user_id, course_id, watched_at from (
          select *, row_number() over (partition by user_id, course_id order by watched_at, id) as pick
          from lms_watch_requests) w
        where pick=1 and not exists (
          select 1 from lms_favorites f where f.user_id=w.user_id and f.course_id=w.course_id)""",
    "promotion_set_diff": """
        select 'add' as action, promotion_id, course_id from (
          select * from lms_wanted_promotion_courses except select * from lms_promotion_courses) a
        union all
        select 'drop', promotion_id, course_id from (
          select * from lms_promotion_courses except select * from lms_wanted_promotion_courses) b""",
    "course_upsert": f"""
        with last as (select * from (
            select *, row_number() over (partition by title order by id desc) as k,
              min(id) over (partition by title) as first_id,
              first_value(created_at) over (partition by title order by id) as first_at
            from lms_course_feed) z where k=1),
          target as (select title, min(id) as id from lms_courses group by 1)
        select c.id, c.title,
          case when l.title is null then c.teacher_id else l.teacher_id end as teacher_id,
          case when l.title is null then c.category_id else l.category_id end as category_id,
          case when l.title is null then c.price else l.price end as price,
          case when l.title is null then c.description else l.description end as description, c.image,
          case when l.title is null then c.level else l.level end as level, c.is_published or l.title is not null
            as is_published, c.created_at
        from lms_courses c left join target t on t.id=c.id left join last l on l.title=t.title
        union all
        select {_fresh('courses', 'first_id')}, title, teacher_id, category_id, price, description, null, level, true, first_at
        from last l where not exists (select 1 from lms_courses c where c.title=l.title)""",
    "user_upsert": f"""
        with feed as (select username, min(id) as id, arg_max(email, id) as email, bool_or(is_superuser) as super
          from lms_user_feed group by 1)
        select u.id, u.username, coalesce(f.email, u.email) as email, u.is_staff or coalesce(f.super, false) as is_staff,
          u.is_superuser or coalesce(f.super, false) as is_superuser
        from lms_users u left join feed f on f.username=u.username
        union all
        select {_fresh('users', 'id')}, username, email, super, super from feed f
        where not exists (select 1 from lms_users u where u.username=f.username)""",
    "course_drafts": f"""
        select {_fresh('courses', 'submitted_at, id')} as id, title, user_id as teacher_id, cast(null as bigint) as category_id, price, description, image,
          'beginner' as level, true as is_published, submitted_at as created_at
        from ({_FORMS}) f""",
    "course_edits": f"""
        with own as (select f.* from ({_FORMS}) f join lms_courses c on c.id=f.course_id and c.teacher_id=f.user_id),
          turn as (select *, row_number() over (partition by course_id order by submitted_at, id) as n from own),
          edit as (select course_id, arg_max(title, n) as title, arg_max(price, n) as price,
            arg_max(description, n) as description, arg_max(image, n) filter (where image is not null) as image
            from turn group by 1)
        select c.id, coalesce(e.title, c.title) as title, c.teacher_id, c.category_id, coalesce(e.price, c.price) as price,
          coalesce(e.description, c.description) as description, coalesce(e.image, c.image) as image, c.level,
          c.is_published, c.created_at
        from lms_courses c left join edit e on e.course_id=c.id""",
    "register_users": f"""
        select {_fresh('users', 'id')} as id, username, email, false as is_staff, false as is_superuser
        from ({_SIGN_UPS}) s""",
    "register_profiles": f"""
        select {_fresh('profiles', 'id')} as id, {_fresh('users', 'id')} as user_id, role from ({_SIGN_UPS}) s""",
    "stream_watch_minutes": f"""
        select user_id, course_id, cast(sum(minutes) as bigint) as watch_minutes from ({_WATCHED.format(id='w.id')}) w group by 1, 2""",
    "stream_review_upsert": _REVIEWS_AFTER,
    "stream_review_compacted": _REVIEWS_AFTER,
}
WRITES["stream_watch_compacted"] = WRITES["stream_watch_minutes"]

# --- cascading deletes ------------------------------------------------------------------
_DEAD = {
    "courses": """select distinct r.course_id as id from lms_delete_requests r
        join lms_courses c on c.id=r.course_id and c.teacher_id=r.user_id
        join lms_profiles p on p.user_id=r.user_id and p.role='teacher'""",
    "chapters": "select id from lms_chapters where course_id in (select id from dead_courses)",
    "lessons": "select id from lms_lessons where chapter_id in (select id from dead_chapters)",
    "orders": "select id from lms_orders where course_id in (select id from dead_courses)",
    "questions": "select id from lms_questions where course_id in (select id from dead_courses)",
}
_DEAD_CTES = ", ".join(f"dead_{t} as ({sql})" for t, sql in _DEAD.items())

# Per table: the keys whose loss deletes a row, and the nullable key that is cleared.
_DELETED_BY = {
    "courses": "id:courses",
    "chapters": "course_id:courses",
    "lessons": "chapter_id:chapters",
    "enrollments": "course_id:courses",
    "learning_records": "course_id:courses",
    "promotion_courses": "course_id:courses",
    "cart_items": "course_id:courses",
    "orders": "course_id:courses",
    "order_items": "course_id:courses order_id:orders",
    "coupon_usages": "order_id:orders",
    "payments": "order_id:orders",
    "refunds": "order_id:orders",
    "favorites": "course_id:courses",
    "reviews": "course_id:courses",
    "questions": "course_id:courses",
    "answers": "question_id:questions",
    "audits": "course_id:courses",
}
_CLEARED = ("learning_records", "questions")


def _gone(table: str) -> str:
    pairs = [p.split(":") for p in _DELETED_BY.get(table, "").split()]
    return " or ".join(f"coalesce({key} in (select id from dead_{t}), false)" for key, t in pairs) or "false"


def _cascade(table: str) -> str:
    star = "*"
    if table in _CLEARED:
        star = (
            "* replace (case when lesson_id in (select id from dead_lessons) then null else lesson_id end as lesson_id)"
        )
    return f"with {_DEAD_CTES} select {star} from lms_{table} where not ({_gone(table)})"


CASCADES = {f"cascade_{t}": _cascade(t) for t in _DELETED_BY}
CASCADES["cascade_delete_counts"] = f"with {_DEAD_CTES} " + _union(
    [
        f"select '{t}' as table_name, count(*) as rows_before, count(*) filter (where not ({_gone(t)})) as rows_left, "
        + (
            f"count(*) filter (where not ({_gone(t)}) and lesson_id in (select id from dead_lessons))"
            if t in _CLEARED
            else "cast(0 as bigint)"
        )
        + f" as rows_cleared from lms_{t}"
        for t in TABLES
    ]
)


# --- quality ----------------------------------------------------------------------------
def _violations(rule: str, checks: list[tuple[str, str, str, str]]) -> str:
    """checks: (table name, source, column, condition)."""
    return _union(
        [
            f"select '{rule}' as rule, '{t}' as table_name, '{c}' as column_name, id from {source} where {cond}"
            for t, source, c, cond in checks
        ]
    )


_FAULTY = {t: f"lms_faulty_{t}" for t in ("orders", "users", "categories", "payments", "notifications")}


def _both(tables: str) -> list[tuple[str, str]]:
    """A table's sound rows and, where there are some, its faulty ones."""
    found = []
    for t in tables.split():
        found.append((t, f"lms_{t}"))
        if t in _FAULTY:
            found.append((t, f"lms_faulty_{t}"))
    return found


_CODES = [
    ("profiles", "role", ROLE),
    ("courses", "level", LEVEL),
    ("coupons", "discount_type", KIND),
    ("user_coupons", "status", USER_COUPON),
    ("promotions", "discount_type", KIND),
    ("orders", "status", ORDER),
    ("payments", "method", METHOD),
    ("payments", "status", PAYMENT),
    ("refunds", "status", REFUND),
    ("audits", "status", AUDIT),
]
_COUNTED = {
    "chapters": "sort_order",
    "lessons": "duration_minutes sort_order",
    "learning_records": "minutes",
    "coupons": "discount_value min_spend usage_limit",
    "promotions": "discount_value",
    "orders": "original_price discount_amount final_price",
    "order_items": "price",
    "coupon_usages": "discount_amount",
    "payments": "amount",
    "refunds": "amount",
    "reviews": "rating",
}
_LENGTHS = {
    "users": "username:150 email:254",
    "profiles": "role:20",
    "categories": "name:100",
    "courses": "title:200 image:100 level:20",
    "chapters": "title:200",
    "lessons": "title:200 video_url:200",
    "coupons": "code:50 name:100 discount_type:20",
    "user_coupons": "status:20",
    "promotions": "name:100 discount_type:20",
    "orders": "status:20",
    "payments": "method:30 status:20 transaction_no:100",
    "refunds": "status:20",
    "notifications": "title:200",
    "questions": "title:200",
    "audits": "status:20",
}
# Required columns; a text that may be blank has no star.
_REQUIRED = {
    "users": "id username* email is_staff is_superuser",
    "profiles": "id user_id role*",
    "categories": "id name* created_at",
    "courses": "id title* teacher_id price description* level* is_published created_at",
    "chapters": "id course_id title* sort_order created_at",
    "lessons": "id chapter_id title* duration_minutes sort_order is_free_preview created_at",
    "enrollments": "id student_id course_id purchased_at",
    "learning_records": "id user_id course_id minutes watched_at",
    "coupons": "id code* name* discount_type* discount_value min_spend start_date end_date usage_limit is_active created_at",
    "user_coupons": "id user_id coupon_id status* received_at",
    "promotions": "id name* discount_type* discount_value start_date end_date is_active created_at",
    "carts": "id user_id created_at updated_at",
    "cart_items": "id cart_id course_id added_at",
    "orders": "id user_id original_price discount_amount final_price status* created_at",
    "order_items": "id order_id course_id price",
    "coupon_usages": "id user_id coupon_id order_id discount_amount used_at",
    "payments": "id order_id method* amount status* created_at",
    "refunds": "id order_id user_id amount reason* status* created_at",
    "favorites": "id user_id course_id created_at",
    "reviews": "id user_id course_id rating created_at updated_at",
    "notifications": "id user_id title* content* is_read created_at",
    "questions": "id user_id course_id title* content* created_at",
    "answers": "id question_id user_id content* created_at",
    "audits": "id course_id status* created_at",
}
_FAULTY_LACKS = {"lms_faulty_categories": ("created_at",)}
_FOREIGN = {
    "profiles": "user_id:users",
    "courses": "teacher_id:users category_id:categories",
    "chapters": "course_id:courses",
    "lessons": "chapter_id:chapters",
    "enrollments": "student_id:users course_id:courses",
    "learning_records": "user_id:users course_id:courses lesson_id:lessons",
    "user_coupons": "user_id:users coupon_id:coupons",
    "carts": "user_id:users",
    "cart_items": "cart_id:carts course_id:courses",
    "orders": "user_id:users course_id:courses coupon_id:coupons",
    "order_items": "order_id:orders course_id:courses",
    "coupon_usages": "user_id:users coupon_id:coupons order_id:orders",
    "payments": "order_id:orders",
    "refunds": "order_id:orders user_id:users",
    "favorites": "user_id:users course_id:courses",
    "reviews": "user_id:users course_id:courses",
    "notifications": "user_id:users",
    "questions": "user_id:users course_id:courses lesson_id:lessons",
    "answers": "question_id:questions user_id:users",
    "audits": "course_id:courses reviewer_id:users",
}


def _missing(column: str) -> str:
    name = column.rstrip("*")
    return f"{name} is null" + (f" or trim(cast({name} as varchar), ' \t\n\r') = ''" if column.endswith("*") else "")


def _repeats(rule: str, checks: list[tuple[str, str, str]]) -> str:
    """checks: (table name, source, key); rows that repeat the key of a row with a lower id."""
    parts = []
    for t, source, key in checks:
        group = key
        if t == "categories" or key == "code":
            group = f"lower({key})"
        present = " and ".join(f"{k} is not null" for k in key.split(","))
        parts.append(
            f"select '{rule}' as rule, '{t}' as table_name, '{key}' as column_name, id from ("
            f"select id, min(id) over (partition by {group}) as first from {source} where {present}) q where id > first"
        )
    return _union(parts)


def _dangling(faulty: dict[str, str], tables: list[str]) -> list[str]:
    parts = []
    for t in tables:
        source = faulty.get(t, f"lms_{t}")
        for pair in _FOREIGN[t].split():
            key, parent = pair.split(":")
            parts.append(
                f"select 'foreign_keys' as rule, '{t}' as table_name, '{key}' as column_name, id from {source} x "
                f"where {key} is not null and not exists (select 1 from {faulty.get(parent, 'lms_' + parent)} p "
                f"where p.id=x.{key})"
            )
    return parts


QUALITY = {
    "dq_choices": _violations(
        "choices",
        [
            (t, source, c, f"{c} not in ({', '.join(repr(code) for code in labels)})")
            for name, c, labels in _CODES
            for t, source in _both(name)
        ],
    ),
    "dq_non_negative": _violations(
        "non_negative",
        [(t, source, c, f"{c} < 0") for name, cs in _COUNTED.items() for t, source in _both(name) for c in cs.split()],
    ),
    "dq_max_length": _violations(
        "max_length",
        [
            (t, source, pair.split(":")[0], f"length({pair.split(':')[0]}) > {pair.split(':')[1]}")
            for name, pairs in _LENGTHS.items()
            for t, source in _both(name)
            for pair in pairs.split()
        ],
    ),
    "dq_required": _violations(
        "required",
        [
            (t, source, c.rstrip("*"), _missing(c))
            for name, cs in _REQUIRED.items()
            for t, source in _both(name)
            for c in cs.split()
            if c not in _FAULTY_LACKS.get(source, ())
        ],
    ),
    "dq_formats": _violations(
        "formats",
        [
            (t, source, "email", "email <> '' and not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")
            for t, source in _both("users")
        ]
        + [
            ("lessons", "lms_lessons", "video_url", "video_url <> '' and not regexp_matches(video_url, '^(?i:https?|ftps?)://[^\\s/?#]+\\S*$')")
        ],
    ),
    "dq_order_arithmetic": _violations(
        "order_arithmetic",
        [
            (t, source, c, cond)
            for t, source in _both("orders")
            for c, cond in (
                ("final_price", "final_price <> original_price - discount_amount"),
                ("discount_amount", "discount_amount > original_price"),
            )
        ],
    ),
    "dq_unique": _repeats(
        "unique",
        [
            ("users", "lms_users", "username"),
            ("users", "lms_faulty_users", "username"),
            ("categories", "lms_categories", "name"),
            ("categories", "lms_faulty_categories", "name"),
            ("coupons", "lms_coupons", "code"),
        ],
    ),
    "dq_unique_pairs": _repeats(
        "unique_pairs",
        [
            ("enrollments", "lms_enrollments", "student_id,course_id"),
            ("cart_items", "lms_cart_items", "cart_id,course_id"),
            ("favorites", "lms_favorites", "user_id,course_id"),
            ("reviews", "lms_reviews", "user_id,course_id"),
            ("reviews", "lms_review_submissions", "user_id,course_id"),
        ],
    ),
    "dq_one_to_one": _repeats(
        "one_to_one",
        [
            ("profiles", "lms_profiles", "user_id"),
            ("carts", "lms_carts", "user_id"),
            ("coupon_usages", "lms_coupon_usages", "order_id"),
            ("profiles", "lms_repeated_profiles", "user_id"),
            ("carts", "lms_repeated_carts", "user_id"),
            ("coupon_usages", "lms_repeated_coupon_usages", "order_id"),
        ],
    ),
    "dq_foreign_keys": _union(
        _dangling({}, list(_FOREIGN)) + _dangling(_FAULTY, ["orders", "order_items", "notifications", "courses", "enrollments", "refunds"])
    ),
}

# --- list pages -------------------------------------------------------------------------
_YEAR_2000 = ("1999-12-31 16:00:00", "2000-12-31 16:00:00")
_JUNE_2000 = ("2000-05-31 16:00:00", "2000-06-30 16:00:00")
_YEAR_1995 = ("1994-12-31 16:00:00", "1995-12-31 16:00:00")
_WEEK_2024 = ("2024-01-08 16:00:00", "2024-01-16 16:00:00")
_JANUARY_2024 = ("2023-12-31 16:00:00", "2024-01-31 16:00:00")


def _within(column: str, span: tuple[str, str]) -> str:
    return f"{column} >= timestamp '{span[0]}' and {column} < timestamp '{span[1]}'"


def _has(words: str, *columns: str) -> str:
    """Every word in at least one column; words are separated by '|'."""
    return " and ".join(
        "(" + " or ".join(f"coalesce(contains(lower(cast({c} as varchar)), '{w}'), false)" for c in columns) + ")"
        for w in words.split("|")
    )


def _page(table: str, shown: str, joins: str, where: str, offset: int = 0) -> str:
    return (
        f"select x.id, {shown} from (select t.* from lms_{table} t {joins} where {where} "
        f"order by t.id desc limit 100 offset {offset}) x"
    )


_USER_COURSE = f"{_U} {_C}"
_USER_L, _COURSE_L = _label("users", "user_id") + ' as "user"', _label("courses", "course_id") + " as course"
_ORDER_SHOWN = (
    f"{_USER_L}, {_COURSE_L}, original_price, discount_amount, final_price, {_case('status', ORDER)} as status, created_at"
)

PAGES = {
    "browse_page": _page("orders", _ORDER_SHOWN, "", "true", 200),
    "browse_deep_page": _page(
        "order_items", f"{_label('orders', 'order_id')} as \"order\", {_COURSE_L}, price", "", "true", 5000
    ),
    "browse_profiles": _page(
        "profiles", f"{_USER_L}, {_case('role', ROLE)} as role", _U, f"role='student' and {_has('customer#00000001', 'u.username')}"
    ),
    "browse_categories": _page("categories", "name, created_at", "", _has("a", "t.name")),
    "browse_courses": _page(
        "courses",
        f"title, {_label('users', 'teacher_id')} as teacher, {_label('categories', 'category_id')} as category, price, "
        f"{_case('level', LEVEL)} as level, is_published, created_at",
        "join lms_users u on u.id=t.teacher_id left join lms_categories k on k.id=t.category_id",
        f"level='advanced' and is_published and {_has('ring|brand#1', 't.title', 'u.username', 'k.name')}",
    ),
    "browse_chapters": _page(
        "chapters", f"{_COURSE_L}, title, sort_order, created_at", _C, _has("widget|chapter 2", "c.title", "t.title")
    ),
    "browse_lessons": _page(
        "lessons",
        f"{_label('chapters', 'chapter_id')} as chapter, title, duration_minutes, sort_order, is_free_preview, created_at",
        "join lms_chapters h on h.id=t.chapter_id join lms_courses c on c.id=h.course_id",
        f"not is_free_preview and {_has('bolt|2-', 'c.title', 'h.title', 't.title')}",
    ),
    "browse_enrollments": _page(
        "enrollments",
        f"{_label('users', 'student_id')} as student, {_COURSE_L}, purchased_at",
        f"join lms_users u on u.id=t.student_id {_C}",
        f"{_within('purchased_at', _YEAR_2000)} and {_has('customer|gear', 'u.username', 'c.title')}",
    ),
    "browse_learning_records": _page(
        "learning_records",
        f"{_USER_L}, {_COURSE_L}, {_label('lessons', 'lesson_id')} as lesson, minutes, watched_at",
        f"{_USER_COURSE} left join lms_lessons s on s.id=t.lesson_id",
        f"{_within('watched_at', _WEEK_2024)} and {_has('ring|2-', 'u.username', 'c.title', 's.title')}",
    ),
    "browse_coupons": _page(
        "coupons",
        f"code, name, {_case('discount_type', KIND)} as discount_type, discount_value, min_spend, start_date, end_date, "
        "usage_limit, is_active",
        "",
        f"discount_type='amount' and is_active and {_has('n', 't.code', 't.name')}",
    ),
    "browse_user_coupons": _page(
        "user_coupons",
        f"{_USER_L}, {_label('coupons', 'coupon_id')} as coupon, {_case('status', USER_COUPON)} as status, received_at, used_at",
        f"{_U} join lms_coupons k on k.id=t.coupon_id",
        f"status='unused' and {_within('received_at', _YEAR_1995)} and {_has('new100|customer', 'u.username', 'k.code')}",
    ),
    "browse_promotions": _page(
        "promotions",
        f"name, {_case('discount_type', KIND)} as discount_type, discount_value, start_date, end_date, is_active",
        "",
        f"discount_type='percent' and is_active and {_has('promo', 't.name')}",
    ),
    "browse_carts": _page("carts", f"{_USER_L}, created_at, updated_at", _U, _has("0000012", "u.username")),
    "browse_cart_items": _page(
        "cart_items",
        f"{_label('carts', 'cart_id')} as cart, {_COURSE_L}, added_at",
        f"join lms_carts k on k.id=t.cart_id join lms_users u on u.id=k.user_id {_C}",
        f"{_within('added_at', _JUNE_2000)} and {_has('customer|brand#2', 'u.username', 'c.title')}",
    ),
    "browse_orders": _page(
        "orders",
        _ORDER_SHOWN,
        f"{_U} left {_C}",
        f"status='paid' and {_within('t.created_at', _YEAR_2000)} and {_has('red|customer', 'u.username', 'c.title')}",
    ),
    "browse_order_items": _page(
        "order_items",
        f"{_label('orders', 'order_id')} as \"order\", {_COURSE_L}, price",
        f"join lms_orders o on o.id=t.order_id join lms_users u on u.id=o.user_id {_C}",
        _has("blue|0001", "u.username", "c.title"),
    ),
    "browse_coupon_usages": _page(
        "coupon_usages",
        f"{_USER_L}, {_label('coupons', 'coupon_id')} as coupon, {_label('orders', 'order_id')} as \"order\", "
        "discount_amount, used_at",
        f"{_U} join lms_coupons k on k.id=t.coupon_id join lms_orders o on o.id=t.order_id "
        "left join lms_courses c on c.id=o.course_id",
        f"{_within('used_at', _YEAR_2000)} and {_has('sale20|hot', 'u.username', 'k.code', 'c.title')}",
    ),
    "browse_payments": _page(
        "payments",
        f"{_label('orders', 'order_id')} as \"order\", {_case('method', METHOD)} as method, amount, "
        f"{_case('status', PAYMENT)} as status, transaction_no, paid_at, created_at",
        "join lms_orders o on o.id=t.order_id join lms_users u on u.id=o.user_id",
        f"t.method='mock' and t.status='paid' and {_within('t.created_at', _YEAR_2000)} "
        f"and {_has('mock-1', 'u.username', 't.transaction_no')}",
    ),
    "browse_refunds": _page(
        "refunds",
        f"{_label('orders', 'order_id')} as \"order\", {_USER_L}, amount, {_case('status', REFUND)} as status, created_at, "
        "processed_at",
        _U,
        f"status='rejected' and {_has('customer|77', 'u.username', 't.order_id')}",
    ),
    "browse_favorites": _page(
        "favorites",
        f"{_USER_L}, {_COURSE_L}, created_at",
        _USER_COURSE,
        f"{_within('t.created_at', _WEEK_2024)} and {_has('bolt', 'u.username', 'c.title')}",
    ),
    "browse_reviews": _page(
        "reviews",
        f"{_USER_L}, {_COURSE_L}, rating, created_at, updated_at",
        _USER_COURSE,
        f"rating=4 and {_within('t.created_at', _JANUARY_2024)} "
        f"and {_has('comment|brand#1', 'u.username', 'c.title', 't.comment')}",
    ),
    "browse_notifications": _page(
        "notifications",
        f"{_USER_L}, title, is_read, created_at",
        _U,
        f"not is_read and {_within('t.created_at', _YEAR_2000)} "
        f"and {_has('purchase|gear', 'u.username', 't.title', 't.content')}",
    ),
    "browse_questions": _page(
        "questions",
        f"{_USER_L}, {_COURSE_L}, {_label('lessons', 'lesson_id')} as lesson, title, created_at",
        _USER_COURSE,
        f"{_within('t.created_at', _YEAR_2000)} and {_has('e|a', 'u.username', 'c.title', 't.title', 't.content')}",
    ),
    "browse_answers": _page(
        "answers",
        f"{_label('questions', 'question_id')} as question, {_USER_L}, created_at",
        f"join lms_questions q on q.id=t.question_id {_U}",
        _has("supplier|e", "q.title", "u.username", "t.content"),
    ),
    "browse_audits": _page(
        "audits",
        f"{_COURSE_L}, {_label('users', 'reviewer_id')} as reviewer, {_case('status', AUDIT)} as status, created_at, "
        "reviewed_at",
        f"{_C} left join lms_users u on u.id=t.reviewer_id",
        f"status='rejected' and {_has('ring|see', 'c.title', 'u.username', 't.comment')}",
    ),
}


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in (METRICS, CATALOG, EXPORTS, CHECKOUT, WRITES, CASCADES, QUALITY, PAGES):
        found.update(group)
    return {name: as_oracle(sql) for name, sql in found.items()}

