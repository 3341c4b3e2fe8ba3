"""Catalogue, course pages and curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code_label, contains_text, first_char, WHITESPACE
from ..operators.lookup import rename
from ..operators.numbering import number_rows
from ..schema import LEVEL, NO_CATEGORY
from ..shop import Shop
from ..store import Store


def course_card_rows(shop: Shop) -> DataFrame:
    """Published courses with teacher and category names."""
    courses = shop["courses"].filter("is_published")
    teachers = rename(shop["users"], teacher_id="id", username="username")
    categories = rename(shop["categories"], category_id="id", category="name")
    return courses.join(teachers, "teacher_id").join(categories, "category_id", "left")


def catalog(shop: Shop) -> DataFrame:
    """The fields of each course card."""
    return course_card_rows(shop).select(
        F.col("id").alias("course_id"),
        "title",
        code_label(F.col("level"), LEVEL).alias("level_label"),
        "category",
        "description",
        "username",
        "price",
        first_char(F.col("title")).alias("title_initial"),
        F.upper(first_char(F.col("username"))).alias("teacher_initial"),
    )


def catalog_count(shop: Shop) -> DataFrame:
    return shop["courses"].filter("is_published").agg(F.count(F.lit(1)).alias("n_courses"))


def matches_keyword(keyword: str, title: Column, teacher: Column) -> Column:
    """The search box: a part of the title or of the teacher's name; an empty box matches all."""
    word = keyword.strip(WHITESPACE + "﻿")
    if not word:
        return F.lit(True)
    return contains_text(title, word) | contains_text(teacher, word)


def in_category(category: Column, wanted: str) -> Column:
    """The category buttons: 'all', an exact name, or the bucket of courses without one."""
    return F.lit(True) if wanted == "all" else F.coalesce(category, F.lit(NO_CATEGORY)) == F.lit(wanted)


def search_catalog(shop: Shop, keyword: str = "", category: str = "all") -> DataFrame:
    cards = course_card_rows(shop)
    return cards.filter(
        matches_keyword(keyword, F.col("title"), F.col("username"))
        & in_category(F.col("category"), category)
    ).select(
        F.col("id").alias("course_id"),
        "title",
        "username",
        F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
    )


def category_facets(shop: Shop) -> DataFrame:
    """Categories that have a published course. Ids are made distinct before names are joined."""
    used = shop["courses"].filter("is_published and category_id is not null").select("category_id").distinct()
    names = rename(shop["categories"], category_id="id", category="name")
    return used.join(names, "category_id").select("category")


def requested_courses(shop: Shop, requests: DataFrame) -> DataFrame:
    """Course page look-ups ``requests(id, course_id)``: title, price, or nothing when there is no such course.

    Unpublished courses are found too.
    """
    found = rename(shop["courses"], course_id="id", title="title", price="price", is_published="is_published")
    return requests.select("id", "course_id").join(found, "course_id", "left").select(
        F.col("id").alias("request_id"),
        "course_id",
        F.col("title").isNotNull().alias("found"),
        "title",
        "price",
        "is_published",
    )


def owned_courses(shop: Shop, requests: DataFrame) -> DataFrame:
    """The requests ``(course_id, user_id)`` that name a course of that very teacher."""
    own = rename(shop["courses"], course_id="id", user_id="teacher_id", title="title")
    return requests.join(own, ["course_id", "user_id"]).select("course_id", "user_id", "title")


def purchase_flags(shop: Shop, visits: DataFrame) -> DataFrame:
    """Course page visits ``(id, user_id, course_id)``: bought already, and the visitor's own rating if bought.

    Purchases and reviews, one row per (user, course) each, are matched first, so the visits are
    joined once.
    """
    bought = shop["enrollments"].select(F.col("student_id").alias("user_id"), "course_id").distinct()
    own = shop["reviews"].select("user_id", "course_id", "rating")
    known = bought.join(own, ["user_id", "course_id"], "left").withColumn("bought", F.lit(True))
    return (
        visits.select("id", "user_id", "course_id")
        .join(known, ["user_id", "course_id"], "left")
        .select(
            F.col("id").alias("visit_id"),
            "user_id",
            "course_id",
            F.coalesce("bought", F.lit(False)).alias("already_purchased"),
            F.col("rating").alias("my_rating"),
        )
    )


def course_reviews(shop: Shop, course_id: int | None = None) -> DataFrame:
    """Reviews with the writer's name, newest first; of one course or, course by course, of all."""
    reviews = shop["reviews"]
    if course_id is not None:
        reviews = reviews.filter(F.col("course_id") == F.lit(course_id))
    writers = rename(shop["users"], user_id="id", username="username")
    return (
        reviews.select("id", "user_id", "course_id", "rating", "comment", "created_at")
        .join(writers, "user_id")
        .orderBy("course_id", F.desc("created_at"), F.desc("id"))
        .select(F.col("id").alias("review_id"), "course_id", "username", "rating", "comment", "created_at")
    )


def _lessons_with_chapter(shop: Shop) -> DataFrame:
    chapters = rename(
        shop["chapters"],
        chapter_id="id",
        course_id="course_id",
        chapter_title="title",
        chapter_order="sort_order",
    )
    lessons = rename(
        shop["lessons"],
        lesson_id="id",
        chapter_id="chapter_id",
        lesson_title="title",
        lesson_order="sort_order",
        duration_minutes="duration_minutes",
        is_free_preview="is_free_preview",
    )
    return chapters.join(lessons, "chapter_id", "left")


def _lesson_label() -> Column:
    return F.concat(
        F.col("chapter_order").cast("string"),
        F.lit("-"),
        F.col("lesson_order").cast("string"),
        F.lit(" "),
        F.col("lesson_title"),
    )


def curriculum_flat(shop: Shop) -> DataFrame:
    """One row per lesson in page order; a chapter without lessons keeps one row with null lesson."""
    return (
        _lessons_with_chapter(shop)
        .select(
            "course_id",
            "chapter_id",
            "chapter_title",
            "chapter_order",
            "lesson_id",
            "lesson_order",
            _lesson_label().alias("label"),
            "duration_minutes",
            "is_free_preview",
        )
        .orderBy("course_id", "chapter_order", "chapter_id", "lesson_order", "lesson_id")
    )


def curriculum(shop: Shop, store: Store, lessons_per_row: int = 500) -> DataFrame:
    """Chapters with their lessons nested.

    A chapter longer than ``lessons_per_row`` continues in the next ``part``, so no array
    and no group grows without bound and nothing is left out.
    """
    placed = number_rows(
        _lessons_with_chapter(shop),
        ["course_id", "chapter_order", "chapter_id"],
        [F.col("lesson_order"), F.col("lesson_id")],
        store,
    )
    lesson = F.when(
        F.col("lesson_id").isNotNull(),
        F.struct("position", "lesson_id", _lesson_label().alias("label"), "duration_minutes", "is_free_preview"),
    )
    part = F.floor((F.col("position") - 1) / lessons_per_row).cast("int")
    return (
        placed.withColumn("part", part)
        .groupBy("course_id", "chapter_order", "chapter_id", "chapter_title", "part")
        .agg(F.sort_array(F.collect_list(lesson)).alias("lessons"))
        .orderBy("course_id", "chapter_order", "chapter_id", "part")
    )


def promotion_coverage(shop: Shop) -> DataFrame:
    """Promotions with the number and total list price of the courses they cover."""
    prices = rename(shop["courses"], course_id="id", price="price")
    covered = (
        shop["promotion_courses"]
        .join(prices, "course_id")
        .groupBy("promotion_id")
        .agg(F.count(F.lit(1)).alias("n_courses"), F.sum("price").alias("list_price"))
    )
    promotions = rename(shop["promotions"], promotion_id="id", promotion="name")
    return promotions.join(covered, "promotion_id", "left").select(
        "promotion_id",
        "promotion",
        F.coalesce("n_courses", F.lit(0)).alias("n_courses"),
        F.coalesce("list_price", F.lit(0)).alias("list_price"),
    )


def users_with_role(shop: Shop) -> DataFrame:
    """Every user with the role of the profile, null where there is no profile."""
    profiles = rename(shop["profiles"], user_id="user_id", role="role")
    users = rename(shop["users"], user_id="id", username="username", email="email")
    return users.join(profiles, "user_id", "left").select(
        "user_id", "username", "email", "role", F.col("role").isNotNull().alias("has_profile")
    )


def order_receipts(shop: Shop, order_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Receipt of each order; with both arguments the one receipt that user may see."""
    orders = shop["orders"]
    if order_id is not None:
        orders = orders.filter((F.col("id") == F.lit(order_id)) & (F.col("user_id") == F.lit(user_id)))
    courses = rename(shop["courses"], course_id="id", course_title="title")
    coupons = rename(shop["coupons"], coupon_id="id", coupon_code="code")
    return (
        orders.select("id", "user_id", "course_id", "coupon_id", "original_price", "discount_amount", "final_price")
        .join(coupons, "coupon_id", "left")
        .join(courses, "course_id", "left")
        .select(
            F.col("id").alias("order_id"),
            "user_id",
            "course_title",
            "original_price",
            "discount_amount",
            "final_price",
            "coupon_code",
        )
    )
