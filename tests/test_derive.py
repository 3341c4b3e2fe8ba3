"""The forms in which Spark gets the definitions of derived tables."""

from __future__ import annotations

import pytest

from checks import derive

SMALL = "/root/testdata/sf0.001"


def test_requests_do_not_broadcast_the_enrollments(spark):
    """A null-aware anti join is broadcast however large it is, by way of the driver."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derive._planned(spark, SMALL, "lms_checkout_requests")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "HashedRelationBroadcastMode" not in plan


@pytest.mark.parametrize("students", [[], [2], [2, 2, 4], [None], [2, None]])
def test_requests_keep_the_meaning_of_not_in(spark, students):
    """Nulls on either side, repeated rows and an empty table."""
    part, form = derive.SPARK_FORMS["lms_checkout_requests"]
    tables = {
        "lms_profiles": spark.createDataFrame(
            [(2, "student"), (4, "teacher"), (6, "student"), (6, "student"), (None, "student"), (8, None)], "user_id bigint, role string"
        ),
        "lms_enrollments": spark.createDataFrame([(s,) for s in students], "student_id bigint"),
    }
    found = []
    for text in (part, form):
        for name in tables:
            text = text.replace(f"from {name}", f"from {{{name}}}")
        rows = spark.sql(f"select user_id {text}", **tables).collect()
        found.append(sorted((r[0] is None, r[0] or 0) for r in rows))
    assert found[0] == found[1]


def test_derived_tables_are_written_compressed(spark):
    files = derive.derived(spark, SMALL, "lms_order_items").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_a_table_in_small_files_is_not_broadcast_whole(spark, store):
    """A million rows of 70 bytes in a file under the threshold, whose size Spark would take for the rows'."""
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    large = spark.range(1_000_000).selectExpr("id", "'a title that is the same in every row of the table, or nearly' as title")
    path = store.fresh_path("titles")
    large.coalesce(1).write.option("compression", "zstd").parquet(path)

    def plan():
        titles = spark.read.parquet(path)
        joined = spark.range(100_000_000).join(titles, "id")
        return joined._jdf.queryExecution().executedPlan().toString()

    try:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "1")
        assert "BroadcastHashJoin" in plan()
        derive.shop_from(spark, SMALL)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", before)


@pytest.mark.parametrize("name", ["lms_order_items", "lms_notifications"])
def test_courses_are_joined_without_a_broadcast(spark, name):
    plan = derive._planned(spark, SMALL, name)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
