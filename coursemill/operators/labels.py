"""One-line display labels of rows, one recipe per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code_label
from ..schema import SEVERAL_COURSES, TABLES, table
from ..shop import Shop
from .paths import columns_over
from .unions import union_all


@dataclass(frozen=True)
class Value:
    """A column, possibly of a parent row; ``missing`` replaces a null."""

    path: tuple[str, ...]
    missing: str | None = None


@dataclass(frozen=True)
class Coded:
    """The display label of a code column."""

    column: str


def _v(*path: str, missing: str | None = None) -> Value:
    return Value(path, missing)


_USER = _v("user_id", "username")
_COURSE = _v("course_id", "title")

# The text of every label is given by these parts, in order.
RECIPES: dict[str, tuple[Value | Coded | str, ...]] = {
    "users": (_v("username"),),
    "profiles": (_USER, " - ", Coded("role")),
    "categories": (_v("name"),),
    "courses": (_v("title"),),
    "chapters": (_COURSE, " - ", _v("title")),
    "lessons": (_v("chapter_id", "title"), " - ", _v("title")),
    "enrollments": (_v("student_id", "username"), " - ", _COURSE),
    "learning_records": (_USER, " - ", _COURSE, " - ", _v("minutes"), " 分鐘"),
    "coupons": (_v("code"), " - ", _v("name")),
    "user_coupons": (_USER, " - ", _v("coupon_id", "code"), " - ", Coded("status")),
    "promotions": (_v("name"),),
    "carts": (_USER, " 的購物車"),
    "cart_items": (_v("cart_id", "user_id", "username"), " - ", _COURSE),
    "orders": (
        _USER,
        " - ",
        _v("course_id", "title", missing=SEVERAL_COURSES),
        " - NT$ ",
        _v("final_price"),
    ),
    "order_items": (_v("order_id"), " - ", _COURSE),
    "coupon_usages": (_USER, " 使用 ", _v("coupon_id", "code")),
    "payments": ("訂單 ", _v("order_id"), " - NT$ ", _v("amount"), " - ", Coded("status")),
    "refunds": (_USER, " - 訂單 ", _v("order_id"), " - ", Coded("status")),
    "favorites": (_USER, " 收藏 ", _COURSE),
    "reviews": (_USER, " - ", _COURSE, " - ", _v("rating"), " 星"),
    "notifications": (_USER, " - ", _v("title")),
    "questions": (_COURSE, " - ", _v("title")),
    "answers": (_v("question_id", "title"), " - ", _USER),
    "audits": (_COURSE, " - ", Coded("status")),
}


def label_frame(shop: Shop, name: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, label) of every row of a table, or of the rows in ``ids``."""
    parts = RECIPES[name]
    paths = {}
    texts: list[Column] = []
    for i, part in enumerate(parts):
        if isinstance(part, str):
            texts.append(F.lit(part))
            continue
        alias = f"_part{i}"
        if isinstance(part, Coded):
            paths[alias] = (part.column,)
            texts.append(code_label(F.col(alias), table(name)[part.column].choices))
            continue
        paths[alias] = part.path
        value = F.col(alias).cast("string")
        texts.append(value if part.missing is None else F.coalesce(value, F.lit(part.missing)))
    return columns_over(shop, name, paths, ids).select("id", F.concat(*texts).alias("label"))


def row_labels(shop: Shop) -> DataFrame:
    """Labels of every row of every labelled table: (table_name, id, label)."""
    frames = [
        label_frame(shop, name).select(F.lit(name).alias("table_name"), "id", "label")
        for name in TABLES
        if name in RECIPES and name != "users"
    ]
    return union_all(frames)


def choice_labels(shop: Shop) -> DataFrame:
    """Every code that occurs, with its label and number of rows: (table_name, column_name, code, label, n_rows)."""
    frames = []
    for name, description in TABLES.items():
        for column in description.coded:
            used = shop[name].groupBy(F.col(column.name).alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))
            frames.append(
                used.select(
                    F.lit(name).alias("table_name"),
                    F.lit(column.name).alias("column_name"),
                    "code",
                    code_label(F.col("code"), column.choices).alias("label"),
                    "n_rows",
                )
            )
    return union_all(frames)
