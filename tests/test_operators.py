"""Browsing, deleting, merging, checking."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.derive import derived
from coursemill import Shop
from coursemill.operators.browse import LISTINGS, browse, search_words
from coursemill.operators.cascade import Deletion, delete_courses
from coursemill.operators.merging import insert_if_absent, set_difference_plan
from coursemill.operators import quality
from coursemill.operators.quality import foreign_key_violations, validate
from coursemill.plans import activity, catalog, charts, metrics
from coursemill.schema import TABLES
from tests.conftest import SMALL


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# --- browsing ---------------------------------------------------------------------------
def test_search_words():
    assert search_words('  a "b c" d\'e \'f g\' a ') == ["a", "b c", "d'e", "f g"]
    assert search_words(None) == search_words("  ") == []


def test_pages_follow_each_other_and_cover_the_table(shop, store):
    pages = [browse(shop, "courses", store, page=p) for p in range(3)]
    ids = [r.id for page in pages for r in page.orderBy(F.desc("id")).collect()]
    assert ids == [r.id for r in shop["courses"].select("id").orderBy(F.desc("id")).collect()]


def test_a_missing_parent_never_drops_a_row(shop, store):
    lost = shop["orders"].filter("course_id is null").count()
    only = shop.replace(orders=shop["orders"].filter("course_id is null"))
    found = sum(browse(only, "orders", store, "customer", page=p).count() for p in range(3))
    assert 0 < lost == found
    assert browse(only, "orders", store, "customer widget").count() == 0
    assert browse(shop, "courses", store, filters={"category_id": None}).count() == min(
        100, shop["courses"].filter("category_id is null").count()
    )


def test_percent_and_underscore_are_ordinary_characters(shop, store):
    assert browse(shop, "courses", store, "%").count() == 0
    assert browse(shop, "courses", store, "_").count() == 0


def test_date_filters_need_a_reference_time(shop, store):
    with pytest.raises(ValueError):
        browse(shop, "orders", store, filters={"created_at": "today"})


def test_filter_over_a_path(shop, store):
    got = browse(shop, "lessons", store, filters={"chapter_id.course_id": 5})
    assert got.count() == 4 and set(LISTINGS["lessons"].filters) == {"chapter_id.course_id", "is_free_preview"}


# --- deleting ---------------------------------------------------------------------------
def test_after_a_deletion_no_key_dangles_and_nothing_else_is_lost(spark, shop, store):
    requests = derived(spark, SMALL, "lms_delete_requests")
    deletion = delete_courses(shop, requests, store)
    left = Shop.of(**{name: store.keep(deletion.remaining(name), name) for name in TABLES})
    assert foreign_key_violations(left, store).isEmpty()
    gone = {r.id for r in shop["courses"].collect()} - {r.id for r in left["courses"].collect()}
    assert 0 < len(gone) < requests.count()  # requests of other teachers are ignored
    assert left["users"].count() == shop["users"].count()
    kept = shop["learning_records"].filter(~F.col("course_id").isin(list(gone)))
    assert left["learning_records"].count() == kept.count()
    cleared = kept.filter("lesson_id is not null").count() - left["learning_records"].filter("lesson_id is not null").count()
    counts = {r.table_name: r for r in deletion.counts().collect()}
    assert counts["learning_records"].rows_cleared == cleared
    assert counts["orders"].rows_left == left["orders"].count()


def test_deleting_a_user_follows_every_edge(spark, store):
    from coursemill.sources.seed import seed_shop

    demo = seed_shop(spark, store, datetime(2024, 1, 1))
    left = {r.table_name: r.rows_left for r in Deletion(demo, "users", demo["users"].filter("id = 2").select("id"), store).counts().collect()}
    # The teacher's two courses go with everything that belongs to them.
    assert (left["courses"], left["chapters"], left["orders"], left["payments"], left["audits"]) == (2, 4, 2, 2, 2)
    assert (left["reviews"], left["questions"], left["answers"], left["users"]) == (1, 0, 0, 5)
    reviewer = Deletion(demo, "users", demo["users"].filter("id = 1").select("id"), store)
    assert reviewer.remaining("audits").filter("reviewer_id is null").count() == 4


# --- merging ----------------------------------------------------------------------------
def test_insert_if_absent_twice_is_the_same_as_once(spark, store):
    old = spark.createDataFrame([(1, 10, "x")], "id bigint, k int, v string")
    new = spark.createDataFrame([(5, 10, "y"), (7, 20, "late"), (6, 20, "early")], "id bigint, k int, v string")
    once = insert_if_absent(old, new, ["k"], ["id"], store)
    assert sorted(map(tuple, once.collect())) == [(1, 10, "x"), (2, 20, "early")]
    assert plain(insert_if_absent(once, new, ["k"], ["id"], store)) == plain(once)


def test_set_difference_plan_applied_gives_the_wanted_set(spark):
    have = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "p int, c int")
    want = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 9)], "p int, c int")
    plan = set_difference_plan(have, want, ["p", "c"])
    assert sorted(map(tuple, plan.collect())) == [("add", 1, 3), ("drop", 1, 1)]


def test_review_upsert_keeps_creation_and_takes_the_last_content(spark, store):
    t = lambda d: datetime(2024, 1, d)
    schema = "id bigint, user_id bigint, course_id bigint, rating int, comment string, created_at timestamp_ntz, updated_at timestamp_ntz"
    shop = Shop.of(
        reviews=spark.createDataFrame([(1, 1, 1, 2, "old", t(1), t(1)), (2, 2, 1, 3, None, t(1), t(1))], schema),
        enrollments=spark.createDataFrame([(1, 1, 1), (2, 3, 1)], "id bigint, student_id bigint, course_id bigint"),
    )
    sent = spark.createDataFrame(
        [
            (10, 1, 1, 4, "better", t(5)),
            (11, 1, 1, 5, " best ", t(6)),
            (12, 3, 1, 1, "  ", t(7)),
            (13, 9, 1, 5, "not a buyer", t(8)),
        ],
        "id bigint, user_id bigint, course_id bigint, rating int, comment string, submitted_at timestamp_ntz",
    )
    after = activity.upsert_reviews(shop, sent, store)
    assert sorted(map(tuple, after.select("id", "user_id", "rating", "comment", "created_at", "updated_at").collect())) == [
        (1, 1, 5, "best", t(1), t(6)),
        (2, 2, 3, None, t(1), t(1)),
        (3, 3, 1, None, t(7), t(7)),
    ]
    assert plain(activity.upsert_reviews(shop.replace(reviews=after), sent, store)) == plain(after)


# --- checking ---------------------------------------------------------------------------
def test_every_rule_finds_its_fault(spark, store):
    from coursemill.sources.seed import seed_shop

    demo = seed_shop(spark, store, datetime(2024, 1, 1))
    change = lambda name, **columns: demo[name].withColumns(columns)
    second = lambda value, column: F.when(F.col("id") == 2, value).otherwise(F.col(column))
    faulty = demo.replace(
        courses=change("courses", level=second(F.lit("expert"), "level"), title=second(F.repeat(F.lit("x"), F.lit(201)), "title")),
        lessons=change("lessons", video_url=second(F.lit("nowhere"), "video_url"), duration_minutes=second(F.lit(-1), "duration_minutes")),
        users=change("users", email=second(F.lit("a@b"), "email"), username=second(F.lit("admin_demo"), "username")),
        coupons=change("coupons", code=second(F.lit("new100"), "code")),
        enrollments=change("enrollments", course_id=second(F.lit(1), "course_id"), student_id=second(F.lit(4), "student_id")),
        carts=change("carts", user_id=F.lit(4)),
        reviews=change("reviews", course_id=second(F.lit(99), "course_id")),
        notifications=change("notifications", title=second(F.lit(" 　"), "title"), content=second(F.lit(None), "content")),
        orders=change("orders", final_price=second(F.lit(1), "final_price")),
    )
    found = {(r.rule, r.table_name, r.column_name, r.id) for r in validate(faulty).collect()}
    assert found == {
        ("choices", "courses", "level", 2),
        ("max_length", "courses", "title", 2),
        ("formats", "lessons", "video_url", 2),
        ("non_negative", "lessons", "duration_minutes", 2),
        ("formats", "users", "email", 2),
        ("unique", "users", "username", 2),
        ("unique", "coupons", "code", 2),
        ("unique_pairs", "enrollments", "student_id,course_id", 2),
        ("one_to_one", "carts", "user_id", 2),
        ("foreign_keys", "reviews", "course_id", 2),
        ("required", "notifications", "title", 2),
        ("required", "notifications", "content", 2),
        ("order_arithmetic", "orders", "final_price", 2),
    }


def test_tables_without_id_and_columns_that_are_absent(spark, store):
    from coursemill.sources.seed import seed_shop

    demo = seed_shop(spark, store, datetime(2024, 1, 1))
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 99), (None, 2)], "promotion_id bigint, course_id bigint")
    faulty = demo.replace(promotion_courses=pairs, categories=demo["categories"].drop("description"))
    found = {(r.rule, r.table_name, r.column_name, r.id) for r in validate(faulty, ["promotion_courses", "categories"]).collect()}
    assert found == {
        ("unique_pairs", "promotion_courses", "promotion_id,course_id", None),
        ("foreign_keys", "promotion_courses", "course_id", None),
        ("required", "promotion_courses", "promotion_id", None),
        ("columns", "categories", "description", None),
    }


def test_dangling_keys_of_all_tables_are_found_by_one_scan_of_each(spark, store):
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    courses = spark.createDataFrame([(1, 1, None), (2, 7, 3)], "id bigint, teacher_id bigint, category_id bigint")
    categories = spark.createDataFrame([], "id bigint")
    # One course is asked for by a third of all rows, and one that does not exist by another third.
    rows = [(i, 1 + i % 2, (1, 99, None if i % 2 else 2)[i % 3]) for i in range(3000)]
    records = spark.createDataFrame(rows, "id bigint, user_id int, course_id bigint").withColumn("lesson_id", F.lit(None).cast("bigint"))
    lessons = spark.createDataFrame([], "id bigint, chapter_id bigint")
    shop = Shop.of(users=users, courses=courses, categories=categories, lessons=lessons, learning_records=records)
    read = Shop.of(**{name: store.keep(shop[name], name) for name in shop})
    found = foreign_key_violations(read, store, ["courses", "learning_records"])
    want = {("courses", "teacher_id", 2), ("courses", "category_id", 2)}
    want |= {("learning_records", "course_id", i) for i, _, c in rows if c == 99}
    assert {(r.table_name, r.column_name, r.id) for r in found.collect()} == want
    # Rows are looked for in the tables with findings alone, each read once more whatever its number of keys.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("teacher_id#") > 0 and plan.count("Relation [id#") == 2
    sound = read.replace(learning_records=read["learning_records"].filter("course_id < 99"))
    assert foreign_key_violations(sound, store, ["learning_records"]).isEmpty()
    assert foreign_key_violations(Shop.of(users=users), store).isEmpty()


def test_key_values_are_put_together_before_the_only_exchange(spark):
    """An anti-join below a distinct would send every row's key values; equal ones are to meet within each task first."""
    ids = [(p, v) for p in (0, 1) for v in (1, 2, 2, None)]
    values = [(p, v, bit) for p in (0, 1) for v in (1, 2, 3, 4) for bit in (1, 2, quality.MOST_KEYS) if v + bit != 5] * 50
    found = quality._dangling(
        [spark.createDataFrame(ids, "parent int, value bigint")],
        [spark.createDataFrame(values[::2], "parent int, value bigint, bit int"), spark.createDataFrame(values[1::2], "parent int, value bigint, bit int")],
    )
    assert sorted(map(tuple, found.collect())) == sorted({x for x in values if x[:2] not in ids})
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange") == 1 and "partial_bit_or" in plan.split("Exchange")[1]


def test_more_keys_to_one_parent_than_a_long_has_bits(spark, store, monkeypatch):
    monkeypatch.setattr(quality, "MOST_KEYS", 1)
    users = spark.createDataFrame([(1,)], "id bigint")
    rows = spark.createDataFrame([(1, 1, 1, 1), (2, 7, 1, None), (3, 1, 8, 9)], "id bigint, order_id bigint, user_id bigint, coupon_id bigint")
    one = spark.createDataFrame([(1,)], "id bigint")
    shop = Shop.of(users=users, orders=one, coupons=one, coupon_usages=rows, refunds=rows.drop("coupon_id"))
    found = foreign_key_violations(shop, store, ["coupon_usages", "refunds"])
    want = {(t, c, i) for t in ("coupon_usages", "refunds") for c, i in (("order_id", 2), ("user_id", 3))}
    assert {(r.table_name, r.column_name, r.id) for r in found.collect()} == want | {("coupon_usages", "coupon_id", 3)}


def test_tables_without_the_rule_are_not_derived(spark, monkeypatch):
    from checks import derive
    from checks.queries import all_queries

    monkeypatch.setattr(derive, "_written", {})
    all_queries()["dq_max_length"](spark, "/root/testdata/sf0.001")
    (written,) = derive._written.values()
    assert "lms_faulty_users" in written and "lms_orders" in written
    assert not {"lms_enrollments", "lms_learning_records", "lms_cart_items", "lms_coupon_usages"} & set(written)


def test_rules_of_each_table(spark):
    """``concerned`` leaves out no table that a rule looks at."""
    from coursemill.schema import TABLES, table

    for name in TABLES:
        df = spark.createDataFrame([], table(name).struct)
        for rule in (*quality.ROW_RULES, *quality.UNIQUE_RULES):
            looked_at = quality.row_violations(name, df, [rule]) or quality.unique_violations(name, df, [rule])
            assert quality.concerned([name], [rule]) == ([name] if looked_at else [])


# --- figures ----------------------------------------------------------------------------
def test_course_figures_add_up_to_teacher_figures(shop):
    by_course = metrics.course_scorecard(shop).groupBy("teacher_id").agg(
        F.sum("total_revenue").alias("r"), F.sum("purchase_count").alias("p"), F.sum("total_watch_minutes").alias("m")
    )
    want = {r.teacher_id: (r.r, r.p, r.m) for r in by_course.collect()}
    got = {r.teacher_id: (r.total_revenue, r.total_purchase_count, r.total_watch_minutes) for r in metrics.teacher_totals(shop).collect()}
    assert got == {t: want[t] for t in got}


def test_a_long_series_continues_in_further_parts(shop, store):
    import json

    whole = {r.teacher_id: json.loads(r.revenue_data_json) for r in charts.teacher_chart_json(shop, store).collect()}
    parts = charts.teacher_chart_json(shop, store, points_per_row=3).orderBy("teacher_id", "part").collect()
    joined = {}
    for r in parts:
        points = json.loads(r.revenue_data_json)
        assert 1 <= len(points) <= 3 and len(points) == len(json.loads(r.course_labels_json))
        joined.setdefault(r.teacher_id, []).extend(points)
    assert joined == whole and len(parts) > len(whole)


def test_curriculum_holds_every_lesson_in_order(shop, store):
    nested = catalog.curriculum(shop, store, lessons_per_row=1).orderBy("course_id", "chapter_order", "chapter_id", "part").collect()
    flat = catalog.curriculum_flat(shop).collect()
    assert [l.label for r in nested for l in r.lessons] == [r.label for r in flat]
    assert max(r.part for r in nested) == 1


def test_a_chapter_without_lessons_stays_in_the_curriculum(spark, store):
    shop = Shop.of(
        chapters=spark.createDataFrame([(1, 1, "empty", 1)], "id bigint, course_id bigint, title string, sort_order bigint"),
        lessons=spark.createDataFrame([], TABLES["lessons"].struct),
    )
    (row,) = catalog.curriculum(shop, store).collect()
    assert row.chapter_title == "empty" and row.lessons == []


def test_single_user_forms_equal_the_rows_of_the_all_users_forms(shop):
    every = metrics.recent_learning(shop)
    user = every.first().user_id
    assert plain(metrics.recent_learning(shop, user)) == plain(every.filter(F.col("user_id") == user).drop("position"))
    course = shop["reviews"].first().course_id
    assert plain(catalog.course_reviews(shop, course)) == plain(
        catalog.course_reviews(shop).filter(F.col("course_id") == course)
    )


def test_titles_merge_under_a_case_and_accent_blind_collation(spark):
    shop = Shop.of(
        courses=spark.createDataFrame([(1, "Café"), (2, "CAFE"), (3, "Tea")], "id bigint, title string"),
        learning_records=spark.createDataFrame([(1, 1, 10), (1, 2, 5), (1, 3, 1)], "user_id bigint, course_id bigint, minutes bigint"),
    )
    assert metrics.student_minutes_by_title(shop).count() == 3
    merged = metrics.student_minutes_by_title(shop, "UNICODE_CI_AI").collect()
    assert [r.total for r in merged] == [15, 1]
