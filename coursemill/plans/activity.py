"""Reviews, watching, starter lessons: what buyers do with their courses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strip
from ..operators.lookup import only_existing, rename
from ..operators.merging import with_new_ids
from ..operators.numbering import first_n
from ..shop import Shop
from ..store import Store

WATCH_MINUTES = 30
STARTER_LESSONS = 2


def buyers_only(shop: Shop, requests: DataFrame) -> DataFrame:
    return only_existing(requests, shop["enrollments"], {"user_id": "student_id", "course_id": "course_id"})


def watched(shop: Shop, requests: DataFrame) -> DataFrame:
    """What watch requests ``(id, user_id, course_id, watched_at)`` of enrolled users record; ids are the requests'."""
    return buyers_only(shop, requests).select(
        "id",
        "user_id",
        "course_id",
        F.lit(None).cast("bigint").alias("lesson_id"),
        F.lit(WATCH_MINUTES).cast("bigint").alias("minutes"),
        "watched_at",
    )


def watch_log(shop: Shop, requests: DataFrame, store: Store) -> DataFrame:
    """New learning records for watch requests, with new ids in time order."""
    return with_new_ids(shop["learning_records"], watched(shop, requests), ["watched_at", "id"], store)


SUBMITTED = ["user_id", "course_id", "rating", "comment", "created_at", "updated_at", "first_id", "last_id"]


def submitted_reviews(shop: Shop, submissions: DataFrame) -> DataFrame:
    """Submissions ``(id, user_id, course_id, rating, comment, submitted_at)`` of buyers, to be merged."""
    return buyers_only(shop, submissions).select(
        "user_id",
        "course_id",
        "rating",
        F.nullif(strip(F.col("comment")), F.lit("")).alias("comment"),
        F.col("submitted_at").alias("created_at"),
        F.col("submitted_at").alias("updated_at"),
        F.col("id").alias("first_id"),
        F.col("id").alias("last_id"),
    )


def merge_submissions(rows: DataFrame) -> DataFrame:
    """One row per (user, course): the first submission gives the creation time, the last the content.

    An aggregation, so it combines on the map side. First and last are told by (time, id of the submission), and
    both ids are carried along, so merging is associative: merged rows can be merged again with others.
    """
    first, last = F.struct("created_at", "first_id"), F.struct("updated_at", "last_id")
    return (
        rows.groupBy("user_id", "course_id")
        .agg(F.min(first).alias("_first"), F.max_by(F.struct("rating", "comment", last.alias("at")), last).alias("_last"))
        .select("user_id", "course_id", "_last.rating", "_last.comment", "_first.*", "_last.at.*")
        .select(*SUBMITTED)
    )


def reviews_with(reviews: DataFrame, merged: DataFrame, store: Store) -> DataFrame:
    """The review table after merged submissions: known reviews keep id and creation time, others are new rows."""
    columns = ["id", "user_id", "course_id", "rating", "comment", "created_at", "updated_at"]
    key = ["user_id", "course_id"]
    changed = merged.select(*key, F.struct("rating", "comment", "updated_at").alias("_new"))
    known = reviews.join(changed, key, "left")
    content = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        for c in ("rating", "comment", "updated_at")
    ]
    known = known.select("id", *key, *content, "created_at").select(*columns)
    new = merged.join(reviews, key, "left_anti").withColumn("id", F.col("first_id"))
    return known.unionByName(with_new_ids(reviews, new.select(*columns), ["created_at", "id"], store))


def upsert_reviews(shop: Shop, submissions: DataFrame, store: Store) -> DataFrame:
    """The review table after a batch of submissions."""
    return reviews_with(shop["reviews"], merge_submissions(submitted_reviews(shop, submissions)), store)


def starter_lessons(shop: Shop) -> DataFrame:
    """Learning records for the first two lessons of each enrolled course that are not recorded yet.

    The two lessons are picked per course, before enrolments multiply them.
    """
    chapters = rename(shop["chapters"], chapter_id="id", course_id="course_id", _chapter_order="sort_order")
    lessons = rename(
        shop["lessons"],
        lesson_id="id",
        chapter_id="chapter_id",
        _lesson_order="sort_order",
        duration_minutes="duration_minutes",
    ).join(chapters, "chapter_id")
    starters = first_n(
        lessons,
        ["course_id"],
        [F.col("_chapter_order"), F.col("_lesson_order"), F.col("lesson_id")],
        STARTER_LESSONS,
    )
    minutes = F.when(F.col("duration_minutes") > 0, F.col("duration_minutes")).otherwise(F.lit(WATCH_MINUTES))
    wanted = (
        rename(shop["enrollments"], user_id="student_id", course_id="course_id", watched_at="purchased_at")
        .join(starters, "course_id")
        .select("user_id", "course_id", "lesson_id", minutes.cast("bigint").alias("minutes"), "watched_at")
    )
    key = {"user_id": "user_id", "course_id": "course_id", "lesson_id": "lesson_id"}
    recorded = shop["learning_records"].select(*[F.col(c).alias(f"_{c}") for c in key])
    return wanted.join(recorded, [F.col(c) == F.col(f"_{c}") for c in key], "left_anti")
