"""The registered queries: library calls over the shop derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill import Shop, Store
from coursemill.functions import coupon_discount, one_decimal
from coursemill.operators import labels, lookup, quality
from coursemill.operators.browse import LISTINGS, browse
from coursemill.operators.cascade import delete_courses
from coursemill.operators.merging import insert_if_absent, set_difference_plan
from coursemill.operators.unions import union_all
from coursemill.plans import accounts, activity, catalog, charts, checkout, exports, metrics
from coursemill.schema import TABLES
from coursemill.sinks import write_csv, write_exports
from coursemill.sources import read_feed
from coursemill.sources.readers import CSV_OPTIONS, column_counts, row_counts
from coursemill.streaming import review_feed, reviews_after, watch_feed, watch_totals

from .derive import derived, shop_from

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2000, 6, 15, 20, 30)
EVENT_NOW = datetime(2024, 1, 15, 20, 30)

# Search term, filters and reference time of each list page.
BROWSE: dict[str, tuple[str | None, dict[str, object], datetime | None]] = {
    "profiles": ("customer#00000001", {"role": "student"}, None),
    "categories": ("a", {}, None),
    "courses": ("ring BRAND#1", {"level": "advanced", "is_published": True}, None),
    "chapters": ("widget 'chapter 2'", {}, None),
    "lessons": ("bolt 2-", {"is_free_preview": False}, None),
    "enrollments": ("customer gear", {"purchased_at": "this_year"}, NOW),
    "learning_records": ("ring 2-", {"watched_at": "past_7_days"}, EVENT_NOW),
    "coupons": ("n", {"discount_type": "amount", "is_active": True}, None),
    "user_coupons": ("new100 customer", {"status": "unused", "received_at": "this_year"}, datetime(1995, 3, 1)),
    "promotions": ("PROMO", {"discount_type": "percent", "is_active": True}, None),
    "carts": ("0000012", {}, None),
    "cart_items": ("customer brand#2", {"added_at": "this_month"}, NOW),
    "orders": ("red customer", {"status": "paid", "created_at": "this_year"}, NOW),
    "order_items": ("blue 0001", {}, None),
    "coupon_usages": ("sale20 hot", {"used_at": "this_year"}, NOW),
    "payments": ("mock-1", {"method": "mock", "status": "paid", "created_at": "this_year"}, NOW),
    "refunds": ("customer 77", {"status": "rejected"}, None),
    "favorites": ("bolt", {"created_at": "past_7_days"}, EVENT_NOW),
    "reviews": ("comment brand#1", {"rating": 4, "created_at": "this_month"}, EVENT_NOW),
    "notifications": ("purchase gear", {"is_read": False, "created_at": "this_year"}, NOW),
    "questions": ("e a", {"created_at": "this_year"}, NOW),
    "answers": ("supplier e", {}, None),
    "audits": ("ring see", {"status": "rejected"}, None),
}


def _on_shop(build: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, folder: build(shop_from(spark, folder))


def _stored(build: Callable[[Shop, Store], DataFrame]) -> Query:
    return lambda spark, folder: build(shop_from(spark, folder), Store(spark))


def _with_feed(name: str, build: Callable[[Shop, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(shop_from(spark, folder), derived(spark, folder, f"lms_{name}"))


def _written(name: str, build: Callable[[Shop, DataFrame, Store], DataFrame]) -> Query:
    return lambda spark, folder: build(shop_from(spark, folder), derived(spark, folder, f"lms_{name}"), Store(spark))


def _purchases(part: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        shop = shop_from(spark, folder)
        done = checkout.checkout(shop, derived(spark, folder, "lms_checkout_requests"), Store(spark))
        return getattr(done, part)()

    return run


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    shop = shop_from(spark, folder)
    priced = checkout.price_checkout(
        shop, checkout.eligible(shop, derived(spark, folder, "lms_checkout_requests"))
    )
    return checkout.accept(shop, priced, Store(spark))


def _planned(part: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        plan = derived(spark, folder, "lms_purchase_plan")
        return getattr(checkout.planned_purchases(shop_from(spark, folder), plan, Store(spark)), part)()

    return run


def _coupon_discounts(shop: Shop) -> DataFrame:
    """Every coupon asked for in a request, applied to the price of the requested course."""
    orders = shop["orders"].filter("coupon_id is not null and course_id is not null")
    coupons = lookup.rename(
        shop["coupons"], coupon_id="id", kind="discount_type", value="discount_value", min_spend="min_spend"
    )
    prices = lookup.rename(shop["courses"], course_id="id", price="price")
    return (
        orders.select("id", "coupon_id", "course_id")
        .join(coupons, "coupon_id")
        .join(prices, "course_id")
        .select(
            F.col("id").alias("order_id"),
            "price",
            coupon_discount(F.col("price"), F.col("min_spend"), F.col("kind"), F.col("value")).alias("discount"),
        )
    )


def _rating_rounding(shop: Shop) -> DataFrame:
    """Averages over many different counts: reviews grouped by course and, besides, by user."""
    groups = [
        shop["reviews"].groupBy(F.lit(key).alias("grouped_by"), F.col(key).alias("group_id"))
        .agg(F.sum("rating").alias("total"), F.count("rating").alias("n"))
        for key in ("course_id", "user_id")
    ]
    sums = groups[0].unionAll(groups[1])
    # Minutes per course add fractions of every kind to those of the few ratings.
    minutes = shop["learning_records"].groupBy(F.lit("minutes").alias("grouped_by"), F.col("course_id").alias("group_id"))
    sums = sums.unionAll(minutes.agg(F.sum("minutes").alias("total"), F.lit(20).cast("bigint").alias("n")))
    return sums.select(
        "grouped_by", "group_id", "total", "n", one_decimal(F.col("total"), F.col("n")).alias("average")
    )


def _lessons_as_text(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("lessons", F.to_json("lessons"))


def _deletion(spark: SparkSession, folder: str):
    return delete_courses(
        shop_from(spark, folder), derived(spark, folder, "lms_delete_requests"), Store(spark)
    )


def _remaining(name: str) -> Query:
    return lambda spark, folder: _deletion(spark, folder).remaining(name)


def _sign_ups(part: int) -> Query:
    return _with_feed("user_feed", lambda shop, feed: accounts.sign_ups(shop, feed, Store(feed.sparkSession))[part])


FAULTY = ("orders", "users", "categories", "payments", "notifications")


def _faulty(spark: SparkSession, folder: str, names: Sequence[str] = FAULTY) -> dict[str, DataFrame]:
    return {name: derived(spark, folder, f"lms_faulty_{name}") for name in names}


def _row_rule(rule: str) -> Query:
    """One single-row rule over the sound tables and the faulty ones."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        shop = shop_from(spark, folder)
        # Tables without this rule are not derived.
        tables = [(n, shop[n]) for n in quality.concerned(shop, [rule])]
        tables += _faulty(spark, folder, quality.concerned(FAULTY, [rule])).items()
        return union_all([f for n, df in tables for f in quality.row_violations(n, df, [rule])])

    return run


def _key_rule(rule: str) -> Query:
    """Uniqueness rules over the sound tables and some in which keys repeat."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        shop = shop_from(spark, folder)
        tables = [(n, shop[n]) for n in quality.concerned(shop, [rule])]
        tables += _faulty(spark, folder, quality.concerned(("users", "categories"), [rule])).items()
        tables += [(n, derived(spark, folder, "lms_review_submissions")) for n in quality.concerned(["reviews"], [rule])]
        if rule == "one_to_one":
            tables += [(n, derived(spark, folder, f"lms_repeated_{n}")) for n in ("profiles", "carts", "coupon_usages")]
        return union_all([f for n, df in tables for f in quality.unique_violations(n, df, [rule])])

    return run


#: Tables whose keys are looked up among the faulty tables as well.
FAULTY_KEYS = ("orders", "order_items", "notifications", "courses", "enrollments", "refunds")


def _foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    shop, store = shop_from(spark, folder), Store(spark)
    faulty = shop.replace(**_faulty(spark, folder))
    sound = quality.foreign_key_violations(shop, store)
    return sound.unionAll(quality.foreign_key_violations(faulty, store, FAULTY_KEYS))


def _csv_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Write all ten exports and count the lines of the files."""
    path = Store(spark).fresh_path("exports")
    write_exports(exports.all_exports(shop_from(spark, folder)), path)
    frames = [
        spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        .csv(f"{path}/{name}.csv")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("export"), "n_rows")
        for name in exports.EXPORTS
    ]
    return union_all(frames)


def _csv_cells(name: str) -> Query:
    """One export written, and every cell of its files read back as text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        export = exports.EXPORTS[name](shop_from(spark, folder))
        path = Store(spark).fresh_path(f"csv-{name}")
        write_csv(export, path)
        names = [f"{c} string" for c in export.columns]
        cells = spark.read.options(**CSV_OPTIONS).schema(", ".join(names)).csv(path)
        return cells.select(*[F.coalesce(c, F.lit("")).alias(c) for c in export.columns])

    return run


def _event_stream(spark: SparkSession, folder: str, store: Store) -> DataFrame:
    """The events in several files, each a micro-batch of its own."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    arriving = store.fresh_path("events")
    events.repartition(4).write.parquet(arriving)
    return read_feed(spark, events.schema, arriving, per_batch=1)


def _stream_watch(spark: SparkSession, folder: str, compact_after: int | None = None) -> DataFrame:
    shop, store = shop_from(spark, folder), Store(spark)
    n_courses = derived(spark, folder, "lms_courses").agg(F.count(F.lit(1))).scalar()
    first = shop["enrollments"].groupBy("student_id").agg(F.min("course_id").alias("_first"))
    requests = (
        _event_stream(spark, folder, store)
        .filter(F.col("event_type").isin("view", "click"))
        .select(F.col("event_id").alias("id"), (F.col("user_id") * 2).alias("user_id"), F.col("ts").alias("watched_at"))
        .join(first, F.col("user_id") == F.col("student_id"), "left")
        .withColumn("_any", F.col("id") % n_courses)
        .withColumn(
            "course_id", F.when(F.col("id") % 2 == 0, F.coalesce("_first", "_any")).otherwise(F.col("_any"))
        )
        .select("id", "user_id", "course_id", "watched_at")
    )
    out = store.fresh_path("watch-minutes")
    watch_feed(shop, requests, out, store.fresh_path("watch-progress"), compact_after).awaitTermination()
    return watch_totals(spark, out)


def _stream_reviews(spark: SparkSession, folder: str, compact_after: int | None = None) -> DataFrame:
    shop, store = shop_from(spark, folder), Store(spark)
    n_courses = derived(spark, folder, "lms_courses").agg(F.count(F.lit(1))).scalar()
    first = shop["enrollments"].groupBy("student_id").agg(F.min("course_id").alias("_first"))
    own = F.when(F.col("event_id") % 2 == 0, F.col("_first"))
    submissions = (
        _event_stream(spark, folder, store)
        .filter(F.col("event_type") == "purchase")
        .join(first, F.col("user_id") * 2 == F.col("student_id"), "left")
        .select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 2).alias("user_id"),
            F.coalesce(own, F.col("event_id") % n_courses).alias("course_id"),
            (F.col("event_id") % 5 + 1).cast("int").alias("rating"),
            F.concat(F.lit("comment "), F.col("event_id").cast("string")).alias("comment"),
            F.col("ts").alias("submitted_at"),
        )
    )
    out = store.fresh_path("review-batches")
    review_feed(shop, submissions, out, store.fresh_path("review-progress"), compact_after).awaitTermination()
    return reviews_after(shop, spark, store, out)


def _browse(name: str) -> Query:
    term, filters, now = BROWSE[name]
    return _stored(lambda shop, store: browse(shop, name, store, term, filters, now))


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "course_scorecard": _on_shop(metrics.course_scorecard),
        "source_row_counts": _on_shop(row_counts),
        "source_column_counts": _on_shop(column_counts),
        # catalogue and course pages
        "catalog": _on_shop(catalog.catalog),
        "catalog_count": _on_shop(catalog.catalog_count),
        "catalog_search": _on_shop(lambda shop: catalog.search_catalog(shop, "  GEAR brand#1 ")),
        "catalog_by_category": _on_shop(lambda shop: catalog.search_catalog(shop, "supplier", "未分類")),
        "catalog_facets": _on_shop(catalog.category_facets),
        "course_by_id": _with_feed(
            "watch_requests",
            lambda shop, visits: catalog.requested_courses(
                shop, visits.select("id", F.col("id").alias("course_id"))
            ),
        ),
        "teacher_owned_courses": _with_feed(
            "course_forms",
            lambda shop, forms: catalog.owned_courses(shop, forms.select("course_id", "user_id").distinct()),
        ),
        "purchase_flags": _with_feed("watch_requests", catalog.purchase_flags),
        "course_reviews": _on_shop(catalog.course_reviews),
        "curriculum": _stored(lambda shop, store: _lessons_as_text(catalog.curriculum(shop, store))),
        "curriculum_parts": _stored(lambda shop, store: _lessons_as_text(catalog.curriculum(shop, store, lessons_per_row=1))),
        "curriculum_flat": _on_shop(catalog.curriculum_flat),
        "promotion_coverage": _on_shop(catalog.promotion_coverage),
        "users_with_role": _on_shop(catalog.users_with_role),
        "order_receipt": _on_shop(catalog.order_receipts),
        "choice_labels": _on_shop(labels.choice_labels),
        "row_labels": _on_shop(labels.row_labels),
        # figures
        "student_kpis": _on_shop(metrics.student_kpis),
        "teacher_totals": _on_shop(metrics.teacher_totals),
        "teacher_course_series": _on_shop(metrics.teacher_course_series),
        "student_minutes_by_title": _on_shop(metrics.student_minutes_by_title),
        "student_minutes_share": _on_shop(metrics.student_minutes_share),
        "course_rating_summary": _on_shop(metrics.course_rating_summary),
        "my_courses": _on_shop(metrics.my_courses),
        "coupon_usage_counts": _on_shop(metrics.coupon_usage_counts),
        "recent_learning": _on_shop(metrics.recent_learning),
        "rating_rounding": _on_shop(_rating_rounding),
        "student_chart_json": _stored(charts.student_chart_json),
        "teacher_chart_json": _stored(charts.teacher_chart_json),
        "student_chart_parts": _stored(lambda shop, store: charts.student_chart_json(shop, store, points_per_row=2)),
        "teacher_chart_parts": _stored(lambda shop, store: charts.teacher_chart_json(shop, store, points_per_row=3)),
        # exports
        "export_row_counts": _on_shop(exports.export_row_counts),
        "export_csv_files": _csv_exports,
        # checkout
        "coupon_discount": _on_shop(_coupon_discounts),
        "coupon_validity": _on_shop(
            lambda shop: checkout.coupon_validity(shop, F.lit("2000-06-15 12:00:00").cast("timestamp_ntz"))
        ),
        "price_checkout": _with_feed("checkout_requests", checkout.price_checkout),
        "checkout_eligible": _with_feed("checkout_requests", checkout.eligible),
        "checkout_accepted": _accepted,
        "planned_orders": _planned("orders"),
        "planned_enrollments": _planned("new_enrollments"),
        "checkout_orders": _purchases("orders"),
        "checkout_order_items": _purchases("order_items"),
        "checkout_payments": _purchases("payments"),
        "checkout_enrollments": _purchases("enrollments"),
        "checkout_coupon_usages": _purchases("coupon_usages"),
        "checkout_notifications": _purchases("notifications"),
        # other write paths
        "review_upsert": _written("review_submissions", activity.upsert_reviews),
        "watch_log": _written("watch_requests", activity.watch_log),
        "starter_lessons": _on_shop(activity.starter_lessons),
        "insert_if_absent": _written(
            "watch_requests",
            lambda shop, visits, store: insert_if_absent(
                shop["favorites"],
                visits.withColumnRenamed("watched_at", "created_at"),
                ["user_id", "course_id"],
                ["created_at", "id"],
                store,
            ),
        ),
        "promotion_set_diff": _with_feed(
            "wanted_promotion_courses",
            lambda shop, wanted: set_difference_plan(
                shop["promotion_courses"], wanted, ["promotion_id", "course_id"]
            ),
        ),
        "course_upsert": _written("course_feed", accounts.upsert_courses),
        "user_upsert": _written("user_feed", accounts.upsert_users),
        "course_drafts": _written("course_forms", accounts.course_drafts),
        "course_edits": _with_feed("course_forms", accounts.course_edits),
        "register_users": _sign_ups(0),
        "register_profiles": _sign_ups(1),
        "cascade_delete_counts": lambda spark, folder: _deletion(spark, folder).counts(),
        # streams
        "stream_watch_minutes": _stream_watch,
        "stream_review_upsert": _stream_reviews,
        "stream_watch_compacted": lambda spark, folder: _stream_watch(spark, folder, compact_after=3),
        "stream_review_compacted": lambda spark, folder: _stream_reviews(spark, folder, compact_after=2),
        # quality
        "dq_foreign_keys": _foreign_keys,
        # list pages
        "browse_page": _stored(lambda shop, store: browse(shop, "orders", store, page=2)),
        "browse_deep_page": _stored(lambda shop, store: browse(shop, "order_items", store, page=50)),
    }
    for name, build in exports.EXPORTS.items():
        found[f"export_{name}"] = _on_shop(build)
        found[f"csv_{name}"] = _csv_cells(name)
    for name in LISTINGS:
        found[f"browse_{name}"] = _browse(name)
    for name in TABLES:
        if name not in ("users", "profiles", "categories", "coupons", "user_coupons", "promotions", "carts", "notifications"):
            found[f"cascade_{name}"] = _remaining(name)
    for rule in quality.ROW_RULES:
        found[f"dq_{rule}"] = _row_rule(rule)
    for rule in quality.UNIQUE_RULES:
        found[f"dq_{rule}"] = _key_rule(rule)
    return found
