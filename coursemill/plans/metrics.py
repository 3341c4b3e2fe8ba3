"""Student, course and teacher figures.

Facts are always aggregated on their key before they meet a dimension: the aggregation
combines on the map side, so a hot course or user costs no more than any other, and what
is joined afterwards has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import one_decimal
from ..operators.lookup import rename
from ..operators.numbering import first_n
from ..shop import Shop

RECENT_RECORDS = 10


def _or_zero(*names: str) -> list:
    return [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]


def minutes_per(shop: Shop, *keys: str) -> DataFrame:
    return shop["learning_records"].groupBy(*keys).agg(F.sum("minutes").alias("watch_minutes"))


def purchases_per_course(shop: Shop) -> DataFrame:
    """Enrolments count as purchases whatever became of the order."""
    return shop["enrollments"].groupBy("course_id").agg(F.count(F.lit(1)).alias("purchase_count"))


def revenue_per_course(shop: Shop) -> DataFrame:
    """Paid single-course orders; an order over several courses counts for none of them."""
    paid = shop["orders"].filter((F.col("status") == "paid") & F.col("course_id").isNotNull())
    return paid.groupBy("course_id").agg(F.sum("final_price").alias("revenue"))


def ratings_per_course(shop: Shop) -> DataFrame:
    return shop["reviews"].groupBy("course_id").agg(
        F.sum("rating").alias("_rating_sum"), F.count("rating").alias("_rating_count")
    )


def course_scorecard(shop: Shop) -> DataFrame:
    """Per course: purchases, minutes watched, revenue and average rating (null without reviews)."""
    courses = rename(
        shop["courses"], course_id="id", title="title", teacher_id="teacher_id", price="price"
    )
    return (
        courses.join(purchases_per_course(shop), "course_id", "left")
        .join(minutes_per(shop, "course_id"), "course_id", "left")
        .join(revenue_per_course(shop), "course_id", "left")
        .join(ratings_per_course(shop), "course_id", "left")
        .select(
            "course_id",
            "title",
            "teacher_id",
            "price",
            *_or_zero("purchase_count"),
            F.coalesce("watch_minutes", F.lit(0)).alias("total_watch_minutes"),
            F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
            one_decimal(F.col("_rating_sum"), F.col("_rating_count")).alias("average_rating"),
        )
    )


def teacher_course_series(shop: Shop) -> DataFrame:
    """The scorecard as the charts use it: a course without reviews has rating 0."""
    return course_scorecard(shop).select(
        "teacher_id",
        "course_id",
        "title",
        "purchase_count",
        F.col("total_revenue").alias("revenue"),
        F.col("total_watch_minutes").alias("watch_minutes"),
        F.coalesce("average_rating", F.lit(0.0)).alias("rating"),
    )


def teacher_totals(shop: Shop) -> DataFrame:
    """Revenue, purchases and minutes over each teacher's own courses."""
    teachers = rename(
        shop["profiles"].filter(F.col("role") == "teacher"), teacher_id="user_id"
    )
    own = rename(shop["courses"], course_id="id", teacher_id="teacher_id")
    totals = (
        own.join(purchases_per_course(shop), "course_id", "left")
        .join(minutes_per(shop, "course_id"), "course_id", "left")
        .join(revenue_per_course(shop), "course_id", "left")
        .groupBy("teacher_id")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("purchase_count").alias("total_purchase_count"),
            F.sum("watch_minutes").alias("total_watch_minutes"),
        )
    )
    return teachers.join(totals, "teacher_id", "left").select(
        "teacher_id", *_or_zero("total_revenue", "total_purchase_count", "total_watch_minutes")
    )


def student_kpis(shop: Shop) -> DataFrame:
    """Minutes watched and courses bought of every user with a profile, with the role."""
    people = rename(shop["profiles"], user_id="user_id", role="role")
    minutes = minutes_per(shop, "user_id")
    bought = (
        shop["enrollments"]
        .groupBy(F.col("student_id").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("purchased_count"))
    )
    return (
        people.join(minutes, "user_id", "left")
        .join(bought, "user_id", "left")
        .select(
            "user_id",
            "role",
            F.coalesce("watch_minutes", F.lit(0)).alias("total_minutes"),
            *_or_zero("purchased_count"),
        )
    )


def minutes_by_title(shop: Shop, collation: str | None = None) -> DataFrame:
    """Minutes per student and course *title*; courses of the same title are one line.

    ``collation`` (for example ``UNICODE_CI_AI``) merges titles that differ in case or accents.
    """
    per_course = minutes_per(shop, "user_id", "course_id")
    titles = rename(shop["courses"], course_id="id", title="title")
    named = per_course.join(titles, "course_id")
    if collation is None:
        return named.groupBy("user_id", "title").agg(F.sum("watch_minutes").alias("total"))
    return (
        named.groupBy("user_id", F.collate("title", collation).alias("_key"))
        .agg(F.min("title").alias("title"), F.sum("watch_minutes").alias("total"))
        .drop("_key")
    )


def student_minutes_by_title(shop: Shop, collation: str | None = None) -> DataFrame:
    """Student by student, the most watched title first."""
    return minutes_by_title(shop, collation).orderBy("user_id", F.desc("total"), "title")


def student_minutes_share(shop: Shop) -> DataFrame:
    """Each title's share of its student's minutes; null when the student has none.

    The student's total is an aggregation joined back, not a window over the student.
    """
    by_title = minutes_by_title(shop)
    totals = minutes_per(shop, "user_id").withColumnRenamed("watch_minutes", "all_minutes")
    return by_title.join(totals, "user_id").select(
        "user_id",
        "title",
        "total",
        F.try_divide(F.col("total").cast("double"), F.col("all_minutes").cast("double")).alias("share"),
    )


def course_rating_summary(shop: Shop) -> DataFrame:
    """Average rating (one decimal) and number of reviews of every course."""
    courses = rename(shop["courses"], course_id="id")
    return courses.join(ratings_per_course(shop), "course_id", "left").select(
        "course_id",
        F.try_divide(F.col("_rating_sum").cast("double"), F.col("_rating_count").cast("double")).alias(
            "raw_average"
        ),
        one_decimal(F.col("_rating_sum"), F.col("_rating_count")).alias("average_rating"),
        F.coalesce("_rating_count", F.lit(0)).alias("review_count"),
    )


def my_courses(shop: Shop) -> DataFrame:
    """Every enrolment of a user with profile: course card, own minutes in it, own minutes in all.

    Everything known per user, and per course, is put together first. Enrolments then meet it in
    one join per key, and a hot user or course is one hot join key, which adaptive execution splits.
    """
    teachers = rename(shop["users"], teacher_id="id", teacher_username="username")
    categories = rename(shop["categories"], category_id="id", category="name")
    courses = (
        rename(
            shop["courses"],
            course_id="id",
            course_title="title",
            description="description",
            teacher_id="teacher_id",
            category_id="category_id",
        )
        .join(teachers, "teacher_id")
        .join(categories, "category_id", "left")
    )
    enrolled = rename(
        shop["enrollments"], enrollment_id="id", user_id="student_id", course_id="course_id", purchased_at="purchased_at"
    )
    in_all = minutes_per(shop, "user_id").withColumnRenamed("watch_minutes", "total_minutes")
    people = shop["profiles"].select("user_id").distinct().join(in_all, "user_id", "left")
    return (
        enrolled.join(people, "user_id")
        .join(minutes_per(shop, "user_id", "course_id"), ["user_id", "course_id"], "left")
        .join(courses, "course_id")
        .select(
            "enrollment_id",
            "user_id",
            "course_id",
            "course_title",
            "description",
            "teacher_username",
            "category",
            "purchased_at",
            *_or_zero("watch_minutes", "total_minutes"),
        )
    )


def coupon_usage_counts(shop: Shop) -> DataFrame:
    """Uses of every coupon, 0 included."""
    uses = shop["coupon_usages"].groupBy("coupon_id").agg(F.count(F.lit(1)).alias("used_count"))
    coupons = rename(shop["coupons"], coupon_id="id", code="code")
    return coupons.join(uses, "coupon_id", "left").select("coupon_id", "code", *_or_zero("used_count"))


def recent_learning(shop: Shop, user_id: int | None = None) -> DataFrame:
    """The ten newest learning records of each student with course and lesson title.

    Titles are joined after the selection, to at most ten rows per student.
    """
    records = shop["learning_records"]
    newest = [F.desc("watched_at"), F.desc("id")]
    if user_id is not None:
        picked = records.filter(F.col("user_id") == F.lit(user_id)).orderBy(*newest).limit(RECENT_RECORDS)
    else:
        picked = first_n(records, ["user_id"], newest, RECENT_RECORDS)
    courses = rename(shop["courses"], course_id="id", course_title="title")
    lessons = rename(shop["lessons"], lesson_id="id", lesson_title="title")
    return picked.join(courses, "course_id").join(lessons, "lesson_id", "left").select(
        F.col("id").alias("record_id"),
        "user_id",
        *(["position"] if user_id is None else []),
        "course_title",
        "lesson_title",
        "minutes",
        "watched_at",
    )
