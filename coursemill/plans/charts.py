"""Chart series as JSON text, the form the analytics pages hand to the browser.

A student or teacher with very many points gets several rows: ``part`` 0, 1, 2 … each hold
``points_per_row`` points, and the whole series is their concatenation. No group is ever
collected beyond that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text
from ..operators.numbering import number_rows
from ..shop import Shop
from ..store import Store
from .metrics import minutes_by_title, teacher_course_series


def _series(df: DataFrame, key: str, points_per_row: int, **points: Column) -> DataFrame:
    """Fold numbered rows into JSON arrays that stay aligned by position."""
    point = F.struct("position", *[text.alias(name) for name, text in points.items()])
    part = F.floor((F.col("position") - 1) / points_per_row).cast("int")
    folded = (
        df.select(key, part.alias("part"), point.alias("_point"))
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list("_point")).alias("_points"))
    )
    arrays = [
        F.concat(F.lit("["), F.array_join(F.col(f"_points.{name}"), ", "), F.lit("]")).alias(name)
        for name in points
    ]
    return folded.select(key, "part", *arrays)


def student_chart_json(shop: Shop, store: Store, points_per_row: int = 1000) -> DataFrame:
    """Titles and minutes of each student, most watched first."""
    ranked = number_rows(
        minutes_by_title(shop), ["user_id"], [F.desc("total"), F.col("title")], store
    )
    return _series(
        ranked,
        "user_id",
        points_per_row,
        course_labels_json=json_text(F.col("title")),
        course_minutes_json=F.col("total").cast("string"),
    )


def teacher_chart_json(shop: Shop, store: Store, points_per_row: int = 1000) -> DataFrame:
    """Title, purchases, revenue, minutes and rating of each teacher's courses, five aligned arrays."""
    ranked = number_rows(teacher_course_series(shop), ["teacher_id"], [F.col("course_id")], store)
    rating = F.when(F.col("rating") == 0, F.lit("0")).otherwise(F.col("rating").cast("string"))
    return _series(
        ranked,
        "teacher_id",
        points_per_row,
        course_labels_json=json_text(F.col("title")),
        purchase_counts_json=F.col("purchase_count").cast("string"),
        revenue_data_json=F.col("revenue").cast("string"),
        watch_minutes_data_json=F.col("watch_minutes").cast("string"),
        rating_data_json=rating,
    )
