"""Watch and review requests as streams.

Each micro-batch writes its own small, already aggregated folder ``batch_id=N``; the current
figures are a merge over the folders that the newest manifest names. Nothing is kept in streaming
state, so state cannot grow with the number of users, and a repeated batch counts once. Both merges are associative:
with ``compact_after`` the live folders become one between batches, and by hand they are merged into another folder,
which is read in their place. A folder belongs to one checkpoint, whose batch numbers it goes by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.activity import SUBMITTED, merge_submissions, reviews_with, submitted_reviews, watched
from ..shop import Shop
from ..store import Store
from .manifest import Manifest, batch_name, compacted_name, live_folders


def _write_batches(
    feed: DataFrame,
    per_batch: Callable[[DataFrame], DataFrame],
    merged: Callable[[SparkSession, Sequence[str]], DataFrame],
    folder: str,
    checkpoint: str,
    compact_after: int | None,
) -> StreamingQuery:
    """Write and commit every batch once; every ``compact_after`` batches the live folders become one."""
    manifest = Manifest(feed.sparkSession, folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not manifest.has(batch_id):
            per_batch(batch).write.mode("overwrite").parquet(f"{folder}/{batch_name(batch_id)}")
            manifest.add(batch_id)
        loose = manifest.loose
        if compact_after and len(loose) >= compact_after:
            whole = merged(batch.sparkSession, manifest.folders())
            whole.write.mode("overwrite").parquet(f"{folder}/{compacted_name(max(loose))}")
            manifest.compacted(max(loose))

    return (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watch_feed(
    shop: Shop, requests: DataFrame, folder: str, checkpoint: str, compact_after: int | None = None
) -> StreamingQuery:
    """Stream of watch requests -> minutes per (user, course) of each batch."""

    def minutes(batch: DataFrame) -> DataFrame:
        return watched(shop, batch).groupBy("user_id", "course_id").agg(F.sum("minutes").alias("watch_minutes"))

    return _write_batches(requests, minutes, _minutes, folder, checkpoint, compact_after)


WATCHED = "user_id bigint, course_id bigint, watch_minutes bigint"


def _minutes(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    batches = spark.read.schema(WATCHED).option("recursiveFileLookup", True).parquet(*folders)
    return batches.groupBy("user_id", "course_id").agg(F.sum("watch_minutes").alias("watch_minutes"))


def watch_totals(spark: SparkSession, *folders: str) -> DataFrame:
    """Minutes per (user, course) over all batches so far, in the stream's folder and in compacted ones."""
    return _minutes(spark, live_folders(spark, folders))


def compact_watched(spark: SparkSession, folders: Sequence[str], out: str) -> None:
    """Write the totals of the batches in ``folders`` as one folder, to be read in their place."""
    _minutes(spark, live_folders(spark, folders)).write.parquet(out)


def review_feed(
    shop: Shop, submissions: DataFrame, folder: str, checkpoint: str, compact_after: int | None = None
) -> StreamingQuery:
    """Stream of review submissions -> merged reviews of each batch."""

    def reviews(batch: DataFrame) -> DataFrame:
        return merge_submissions(submitted_reviews(shop, batch))

    return _write_batches(submissions, reviews, _submissions, folder, checkpoint, compact_after)


def _submissions(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    schema = (
        "user_id bigint, course_id bigint, rating int, comment string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, first_id bigint, last_id bigint"
    )
    batches = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)
    return merge_submissions(batches.select(*SUBMITTED))


def reviews_after(shop: Shop, spark: SparkSession, store: Store, *folders: str) -> DataFrame:
    """The review table after all batches so far, in the stream's folder and in compacted ones."""
    return reviews_with(shop["reviews"], _submissions(spark, live_folders(spark, folders)), store)


def compact_reviews(spark: SparkSession, folders: Sequence[str], out: str) -> None:
    """Write the merge of the batches in ``folders`` as one folder, to be read in their place."""
    _submissions(spark, live_folders(spark, folders)).write.parquet(out)
