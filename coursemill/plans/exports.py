"""The ten flat exports for BI tools.

Names are attached to the smaller parent first (order + user, course + teacher), so a fact
table is shuffled once per parent at most, and not at all for parents small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code_label
from ..operators.lookup import rename
from ..operators.unions import union_all
from ..schema import LEVEL, ROLE
from ..shop import Shop


def _users(shop: Shop, key: str, username: str = "username", email: str | None = None) -> DataFrame:
    wanted = {key: "id", username: "username"}
    if email:
        wanted[email] = "email"
    return rename(shop["users"], **wanted)


def _courses(shop: Shop, teacher: bool = True) -> DataFrame:
    courses = rename(shop["courses"], course_id="id", course_title="title", teacher_id="teacher_id")
    if not teacher:
        return courses.drop("teacher_id")
    return courses.join(_users(shop, "teacher_id", "teacher_username"), "teacher_id").drop("teacher_id")


def _order_owner(shop: Shop) -> DataFrame:
    orders = rename(shop["orders"], order_id="id", user_id="user_id")
    return orders.join(_users(shop, "user_id"), "user_id").drop("user_id")


def export_courses(shop: Shop) -> DataFrame:
    categories = rename(shop["categories"], category_id="id", category="name")
    teachers = _users(shop, "teacher_id", "teacher_username", "teacher_email")
    return (
        shop["courses"]
        .join(teachers, "teacher_id")
        .join(categories, "category_id", "left")
        .select(
            F.col("id").alias("course_id"),
            F.col("title").alias("course_title"),
            "teacher_username",
            "teacher_email",
            F.coalesce("category", F.lit("")).alias("category"),
            code_label(F.col("level"), LEVEL).alias("level"),
            "price",
            "description",
            "is_published",
            "created_at",
        )
    )


def export_enrollments(shop: Shop) -> DataFrame:
    students = _users(shop, "student_id", "student_username", "student_email")
    return (
        shop["enrollments"]
        .join(students, "student_id")
        .join(_courses(shop), "course_id")
        .select(
            F.col("id").alias("enrollment_id"),
            "student_username",
            "student_email",
            "course_id",
            "course_title",
            "teacher_username",
            "purchased_at",
        )
    )


def export_learning_records(shop: Shop) -> DataFrame:
    lessons = rename(shop["lessons"], lesson_id="id", lesson_title="title")
    return (
        shop["learning_records"]
        .join(_users(shop, "user_id", email="email"), "user_id")
        .join(_courses(shop), "course_id")
        .join(lessons, "lesson_id", "left")
        .select(
            F.col("id").alias("record_id"),
            "username",
            "email",
            "course_id",
            "course_title",
            "teacher_username",
            F.coalesce("lesson_title", F.lit("")).alias("lesson_title"),
            "minutes",
            "watched_at",
        )
    )


def export_profiles(shop: Shop) -> DataFrame:
    return (
        shop["profiles"]
        .join(_users(shop, "user_id", email="email"), "user_id")
        .select(
            F.col("id").alias("profile_id"),
            "username",
            "email",
            "role",
            code_label(F.col("role"), ROLE).alias("role_display"),
        )
    )


def export_orders(shop: Shop) -> DataFrame:
    coupons = rename(shop["coupons"], coupon_id="id", coupon_code="code")
    return (
        shop["orders"]
        .join(_users(shop, "user_id", email="email"), "user_id")
        .join(coupons, "coupon_id", "left")
        .join(_courses(shop, teacher=False), "course_id", "left")
        .select(
            F.col("id").alias("order_id"),
            "username",
            "email",
            F.coalesce(F.when(F.col("course_title").isNotNull(), F.col("course_id").cast("string")), F.lit("")).alias(
                "course_id"
            ),
            F.coalesce("course_title", F.lit("")).alias("course_title"),
            F.coalesce("coupon_code", F.lit("")).alias("coupon_code"),
            "original_price",
            "discount_amount",
            "final_price",
            "status",
            "created_at",
        )
    )


def export_order_items(shop: Shop) -> DataFrame:
    return (
        shop["order_items"]
        .join(_courses(shop), "course_id")
        .join(_order_owner(shop), "order_id")
        .select(
            F.col("id").alias("order_item_id"),
            "order_id",
            "username",
            "course_id",
            "course_title",
            "teacher_username",
            "price",
        )
    )


def export_payments(shop: Shop) -> DataFrame:
    return (
        shop["payments"]
        .join(_order_owner(shop), "order_id")
        .select(
            F.col("id").alias("payment_id"),
            "order_id",
            "username",
            "method",
            "amount",
            "status",
            "transaction_no",
            "paid_at",
            "created_at",
        )
    )


def export_coupon_usage(shop: Shop) -> DataFrame:
    """The order only supplies its own id, which the usage row already has."""
    coupons = rename(shop["coupons"], coupon_id="id", coupon_code="code", coupon_name="name")
    return (
        shop["coupon_usages"]
        .join(coupons, "coupon_id")
        .join(_users(shop, "user_id"), "user_id")
        .select(
            F.col("id").alias("coupon_usage_id"),
            "username",
            "coupon_code",
            "coupon_name",
            "order_id",
            "discount_amount",
            "used_at",
        )
    )


def export_reviews(shop: Shop) -> DataFrame:
    return (
        shop["reviews"]
        .join(_users(shop, "user_id", email="email"), "user_id")
        .join(_courses(shop), "course_id")
        .select(
            F.col("id").alias("review_id"),
            "username",
            "email",
            "course_id",
            "course_title",
            "teacher_username",
            "rating",
            "comment",
            "created_at",
            "updated_at",
        )
    )


def export_course_lessons(shop: Shop) -> DataFrame:
    """Lessons in course, chapter and lesson order."""
    chapters = rename(
        shop["chapters"],
        chapter_id="id",
        course_id="course_id",
        chapter_title="title",
        _chapter_order="sort_order",
    ).join(_courses(shop, teacher=False), "course_id")
    return (
        shop["lessons"]
        .withColumnsRenamed({"id": "lesson_id", "title": "lesson_title"})
        .join(chapters, "chapter_id")
        .orderBy("course_id", "_chapter_order", "chapter_id", "sort_order", "lesson_id")
        .select(
            "lesson_id",
            "course_id",
            "course_title",
            "chapter_id",
            "chapter_title",
            "lesson_title",
            "duration_minutes",
            "is_free_preview",
            "sort_order",
            "created_at",
        )
    )


EXPORTS = {
    "courses": export_courses,
    "enrollments": export_enrollments,
    "learning_records": export_learning_records,
    "profiles": export_profiles,
    "orders": export_orders,
    "order_items": export_order_items,
    "payments": export_payments,
    "coupon_usage": export_coupon_usage,
    "reviews": export_reviews,
    "course_lessons": export_course_lessons,
}


def all_exports(shop: Shop) -> dict[str, DataFrame]:
    return {name: build(shop) for name, build in EXPORTS.items()}


def export_row_counts(shop: Shop) -> DataFrame:
    """Number of data rows of each export."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("export"), "n_rows")
        for name, df in all_exports(shop).items()
    ]
    return union_all(counts)
