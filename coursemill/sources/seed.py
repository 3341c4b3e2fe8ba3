"""A small demo shop: fixed rows for people and courses, the library's own jobs for the rest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time_literal
from ..operators.numbering import number_rows
from ..plans.activity import starter_lessons
from ..plans.checkout import planned_purchases
from ..schema import TABLES
from ..shop import Shop
from ..store import Store

# --- Fixed values of the demo data set -------------------------------------------------
USERS = [
    (1, "admin_demo", "admin@example.com", None),
    (2, "teacher_python", "teacher_python@example.com", "teacher"),
    (3, "teacher_design", "teacher_design@example.com", "teacher"),
    (4, "student_amy", "amy@example.com", "student"),
    (5, "student_ben", "ben@example.com", "student"),
    (6, "student_cindy", "cindy@example.com", "student"),
]
CATEGORIES = [(1, "程式設計"), (2, "設計與行銷"), (3, "商業管理")]
COURSES = [
    (1, "Python Django 線上課程平台實作", 2, 1, 1800, "intermediate"),
    (2, "MySQL 資料庫設計與 ERD 實戰", 2, 1, 1500, "beginner"),
    (3, "Power BI 商業數據分析入門", 3, 3, 2000, "beginner"),
    (4, "UI/UX 介面設計與平台首頁規劃", 3, 2, 1200, "beginner"),
]
CHAPTERS = [(1, "第一章：課程導入"), (2, "第二章：核心實作")]
LESSONS = [
    (1, 1, "1-1 課程介紹與學習目標", 15, True),
    (1, 2, "1-2 開發環境與工具介紹", 20, False),
    (2, 1, "2-1 核心功能設計", 35, False),
    (2, 2, "2-2 資料庫與報表分析", 40, False),
]
COUPONS = [
    (1, "NEW100", "新會員折扣", "amount", 100, 500, 60, 0),
    (2, "SALE20", "限時八折優惠", "percent", 20, 1000, 30, 100),
]
PROMOTION = (1, "期末專題優惠活動", "percent", 15, 30)
CARTS = [(1, 4, 2), (2, 5, 3)]
PURCHASES = [(1, 4, 1, 1), (2, 4, 3, None), (3, 5, 1, 2), (4, 5, 2, None), (5, 6, 4, 1)]
FAVORITES = [(1, 4, 2), (2, 5, 3), (3, 6, 1)]
REVIEWS = [(1, 4, 1, 5), (2, 5, 1, 4), (3, 6, 4, 5)]
STUDENTS = [4, 5, 6]
WELCOME_TITLE = "歡迎加入 Course Platform"
QUESTION_TITLE = "Django 和 MySQL 的資料表是怎麼連動的？"
# ----------------------------------------------------------------------------------------


def seed_shop(spark: SparkSession, store: Store, now: datetime) -> Shop:
    """The demo shop as of ``now``. Free texts that no figure depends on are left short."""
    at = time_literal(now, TABLES["orders"]["created_at"].spark_type)

    def days(n: int) -> Column:
        return at + F.make_interval(days=F.lit(n))

    def rows(name: str, values: list[tuple], columns: str, **more: Column) -> DataFrame:
        """Fixed rows, ``more`` columns, and the table's defaults or nulls for what is left."""
        df = spark.createDataFrame(values, columns)
        for column, value in more.items():
            df = df.withColumn(column, value)
        filled = []
        for c in TABLES[name].columns:
            value = F.col(c.name) if c.name in df.columns else F.lit(c.default)
            filled.append(value.cast(c.spark_type).alias(c.name))
        return df.select(*filled)

    users = [(i, name, email, role is None) for i, name, email, role in USERS]
    chapters = [(c[0] * 2 + k - 2, c[0], title, k) for c in COURSES for k, title in CHAPTERS]
    lessons = [
        (chapter * 2 + order - 2, chapter, title, minutes, order, free)
        for chapter, _, _, k in chapters
        for of_chapter, order, title, minutes, free in LESSONS
        if of_chapter == k
    ]
    tables = {
        "users": rows(
            "users", users, "id int, username string, email string, is_superuser boolean",
            is_staff=F.col("is_superuser"),
        ),
        "profiles": rows(
            "profiles",
            [(n, u[0], u[3]) for n, u in enumerate((u for u in USERS if u[3]), start=1)],
            "id int, user_id int, role string",
        ),
        "categories": rows("categories", CATEGORIES, "id int, name string", created_at=at),
        "courses": rows(
            "courses",
            COURSES,
            "id int, title string, teacher_id int, category_id int, price int, level string",
            description=F.col("title"),
            created_at=at,
        ),
        "chapters": rows(
            "chapters", chapters, "id int, course_id int, title string, sort_order int", created_at=at
        ),
        "lessons": rows(
            "lessons",
            lessons,
            "id int, chapter_id int, title string, duration_minutes int, sort_order int, is_free_preview boolean",
            created_at=at,
        ),
        "coupons": rows(
            "coupons",
            COUPONS,
            "id int, code string, name string, discount_type string, discount_value int, min_spend int, "
            "valid_days int, usage_limit int",
            start_date=days(-1),
            end_date=at + F.make_interval(days=F.col("valid_days")),
            created_at=at,
        ),
        "promotions": rows(
            "promotions",
            [PROMOTION],
            "id int, name string, discount_type string, discount_value int, valid_days int",
            start_date=days(-1),
            end_date=at + F.make_interval(days=F.col("valid_days")),
            created_at=at,
        ),
        "promotion_courses": rows(
            "promotion_courses", [(1, c[0]) for c in COURSES], "promotion_id int, course_id int"
        ),
        "user_coupons": rows(
            "user_coupons",
            [(n, u, 1) for n, u in enumerate(STUDENTS, start=1)],
            "id int, user_id int, coupon_id int",
            received_at=at,
        ),
        "carts": rows(
            "carts", [c[:2] for c in CARTS], "id int, user_id int", created_at=at, updated_at=at
        ),
        "cart_items": rows(
            "cart_items", [(c[0], c[0], c[2]) for c in CARTS], "id int, cart_id int, course_id int", added_at=at
        ),
        "favorites": rows(
            "favorites", FAVORITES, "id int, user_id int, course_id int", created_at=at
        ),
        "reviews": rows(
            "reviews",
            REVIEWS,
            "id int, user_id int, course_id int, rating int",
            created_at=at,
            updated_at=at,
        ),
        "notifications": rows(
            "notifications",
            [(n, u, WELCOME_TITLE, WELCOME_TITLE) for n, u in enumerate(STUDENTS, start=1)],
            "id int, user_id int, title string, content string",
            created_at=at,
        ),
        "questions": rows(
            "questions",
            [(1, 4, 1, QUESTION_TITLE, QUESTION_TITLE)],
            "id int, user_id int, course_id int, title string, content string",
            created_at=at,
        ),
        "answers": rows(
            "answers", [(1, 1, 2, "models.py")], "id int, question_id int, user_id int, content string", created_at=at
        ),
        "audits": rows(
            "audits",
            [(c[0], c[0], 1, "approved") for c in COURSES],
            "id int, course_id int, reviewer_id int, status string",
            created_at=at,
            reviewed_at=at,
        ),
        "refunds": spark.createDataFrame([], TABLES["refunds"].struct),
    }
    for empty in ("orders", "order_items", "payments", "enrollments", "coupon_usages", "learning_records"):
        tables[empty] = spark.createDataFrame([], TABLES[empty].struct)

    plan = spark.createDataFrame(PURCHASES, "id bigint, user_id bigint, course_id bigint, coupon_id bigint")
    bought = planned_purchases(Shop.of(**tables), plan.withColumn("requested_at", at), store).new_rows()
    bought.pop("notifications")
    shop = Shop.of(**tables).replace(**bought)
    order = [F.col("user_id"), F.col("course_id"), F.col("lesson_id")]
    watched = number_rows(starter_lessons(shop), [], order, store, "id")
    return shop.replace(
        learning_records=watched.select(*[c.name for c in TABLES["learning_records"].columns])
    )

