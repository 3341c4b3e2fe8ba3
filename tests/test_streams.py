"""Streams give what the batch jobs give, whatever the batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.derive import derived
from coursemill import Shop
from coursemill.plans import activity
from coursemill.sources import read_feed
from coursemill.streaming import compact_reviews, compact_watched, review_feed, reviews_after, watch_feed, watch_totals
from coursemill.streaming.manifest import batch_name, live_folders, versions
from tests.conftest import SMALL
from tests.test_operators import plain


def arriving(spark, store, df, files=5):
    """The rows of ``df`` as several files that a stream reads one per batch."""
    folder = store.fresh_path("arriving")
    df.repartition(files).write.parquet(folder)
    return read_feed(spark, df.schema, folder, per_batch=1)


def test_watch_stream_equals_batch_and_survives_a_repeat(spark, store, shop):
    requests = derived(spark, SMALL, "lms_watch_requests")
    want = activity.watched(shop, requests).groupBy("user_id", "course_id").agg(F.sum("minutes").alias("watch_minutes"))
    out, progress = store.fresh_path("out"), store.fresh_path("progress")
    feed = arriving(spark, store, requests)
    query = watch_feed(shop, feed, out, progress)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert plain(watch_totals(spark, out)) == plain(want)
    compact = store.fresh_path("compact")
    compact_watched(spark, [out], compact)
    assert plain(watch_totals(spark, compact)) == plain(want)
    # The same batches once more, as after a failure before the commit: nothing counts twice.
    watch_feed(shop, feed, out, store.fresh_path("progress")).awaitTermination()
    assert plain(watch_totals(spark, out)) == plain(want)
    # Nothing new has arrived: the finished stream has nothing to do.
    watch_feed(shop, feed, out, progress).awaitTermination()
    assert plain(watch_totals(spark, out)) == plain(want)


def test_review_stream_equals_batch(spark, store, shop):
    submissions = derived(spark, SMALL, "lms_review_submissions")
    # Make every submitter a buyer so that many keys are replaced, several times.
    buyers = submissions.select(F.col("user_id").alias("student_id"), "course_id").distinct().withColumn("id", F.lit(1))
    busy = shop.replace(enrollments=buyers, reviews=shop["reviews"].filter("id % 2 = 0"))
    out = store.fresh_path("out")
    review_feed(busy, arriving(spark, store, submissions), out, store.fresh_path("progress")).awaitTermination()
    want = activity.upsert_reviews(busy, submissions, store)
    assert plain(reviews_after(busy, spark, store, out)) == plain(want)
    compact = store.fresh_path("compact")
    compact_reviews(spark, [out], compact)
    assert plain(reviews_after(busy, spark, store, compact)) == plain(want)


def test_merging_in_steps_equals_merging_at_once_when_times_are_equal(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [(1, 1, 2, "a", t(1)), (9, 1, 3, "b", t(5)), (5, 1, 4, "c", t(5)), (7, 2, 1, None, t(2))]
    schema = "id bigint, user_id bigint, rating int, comment string, submitted_at timestamp_ntz"
    sent = spark.createDataFrame(rows, schema).withColumn("course_id", F.lit(1).cast("bigint"))
    buyers = sent.select(F.col("user_id").alias("student_id"), "course_id").distinct()
    submitted = activity.submitted_reviews(Shop.of(enrollments=buyers), sent)
    at_once = plain(activity.merge_submissions(submitted))
    first = activity.merge_submissions(submitted.filter("first_id in (1, 9)"))
    rest = submitted.filter("first_id in (5, 7)")
    assert plain(activity.merge_submissions(first.unionByName(rest))) == at_once
    assert plain(activity.merge_submissions(rest.unionByName(first))) == at_once


def names(folders):
    return [f.rsplit("/", 1)[-1] for f in folders]


def test_compaction_between_batches_changes_no_figure_and_survives_repeats(spark, store, shop):
    requests = derived(spark, SMALL, "lms_watch_requests")
    want = activity.watched(shop, requests).groupBy("user_id", "course_id").agg(F.sum("minutes").alias("watch_minutes"))
    out, feed = store.fresh_path("out"), arriving(spark, store, requests)
    watch_feed(shop, feed, out, store.fresh_path("progress"), compact_after=2).awaitTermination()
    assert names(live_folders(spark, [out])) == ["through_id=3", "batch_id=4"]
    assert plain(watch_totals(spark, out)) == plain(want)

    # Five batches and two compactions; whoever reads by the version before a compaction sees the figures of the one after.
    assert sorted(r.version for r in versions(spark, out).collect()) == [1, 2, 3, 4, 5, 6, 7]
    for before, after in ((2, 3), (5, 6)):
        old, new = (live_folders(spark, [out], v) for v in (before, after))
        assert len(old) > 1 and len(new) == 1
        assert plain(watch_totals(spark, *old)) == plain(watch_totals(spark, *new)) and not watch_totals(spark, *new).isEmpty()

    # A batch or a compaction that was written but not committed does not count.
    for left in (batch_name(5), "through_id=4"):
        spark.sql("select 1L as user_id, 1L as course_id, 999L as watch_minutes").write.parquet(f"{out}/{left}")
    assert plain(watch_totals(spark, out)) == plain(want)

    # All batches once more, as after a lost checkpoint: those inside the compacted folder count once, too.
    watch_feed(shop, feed, out, store.fresh_path("progress"), compact_after=2).awaitTermination()
    assert plain(watch_totals(spark, out)) == plain(want) and versions(spark, out).count() == 7

    # The rest is compacted when asked for earlier, and takes the place of what was left there.
    watch_feed(shop, feed, out, store.fresh_path("progress"), compact_after=1).awaitTermination()
    assert names(live_folders(spark, [out])) == ["through_id=4"]
    assert plain(watch_totals(spark, out)) == plain(want)
