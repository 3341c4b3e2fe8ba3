"""Positions, selections and joins when one key holds most of the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from coursemill.operators.lookup import rename
from coursemill.operators.numbering import first_n, number_rows, one_per_key


def skewed(spark, n=20000, hot=0.6, seed=1):
    rng = random.Random(seed)
    rows = [(i, 7 if rng.random() < hot else rng.randrange(200), rng.randrange(500)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, k bigint, v bigint").repartition(8), rows


def test_number_rows_equals_sorting_each_group(spark, store):
    df, rows = skewed(spark)
    got = number_rows(df, ["k"], [F.desc("v"), F.col("id")], store).collect()
    groups = {}
    for i, k, v in rows:
        groups.setdefault(k, []).append((-v, i))
    want = {i: p for g in groups.values() for p, (_, i) in enumerate(sorted(g), start=1)}
    assert {r.id: r.position for r in got} == want


def test_number_rows_over_a_whole_table_and_null_keys(spark, store):
    df = spark.createDataFrame([(i, None if i % 3 else 1) for i in range(100)], "id bigint, k bigint")
    whole = number_rows(df, [], [F.col("id")], store)
    assert [r.position for r in whole.orderBy("id").collect()] == list(range(1, 101))
    by_key = number_rows(df, ["k"], [F.col("id")], store)
    assert by_key.count() == 100 and by_key.filter("k is null").agg(F.max("position")).first()[0] == 66


def test_a_hot_group_is_numbered_by_several_tasks(spark):
    """The sort that places the rows cuts the hot key into several partitions."""
    df, _ = skewed(spark, hot=0.9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.orderBy("k", "v", "id").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.5 * df.count()


def test_first_n_limits_each_group_before_the_shuffle(spark):
    df, rows = skewed(spark)
    top = first_n(df, ["k"], [F.desc("v"), F.desc("id")], 10)
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    hot = sorted(((v, i) for i, k, v in rows if k == 7), reverse=True)[:10]
    assert [(r.v, r.id) for r in top.filter("k = 7").orderBy("position").collect()] == hot


def test_one_per_key_combines_before_the_shuffle(spark):
    df, rows = skewed(spark)
    first = one_per_key(df, ["k"], ["v", "id"])
    assert "partial_min_by" in first._jdf.queryExecution().toString()
    want = {}
    for i, k, v in rows:
        want[k] = min(want.get(k, (v, i)), (v, i))
    assert {r.k: (r.v, r.id) for r in first.collect()} == want


def test_a_hot_join_key_is_split(spark):
    """A fact table joined with a parent too large to broadcast: the hot partition is read in pieces."""
    df, rows = skewed(spark, n=60000, hot=0.8)
    parents = spark.range(200).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        joined = df.join(rename(parents, k="id", name="name"), "k", "left")
        assert joined.groupBy("name").count().count() == len({k for _, k, _ in rows})
        joined.write.format("noop").mode("overwrite").save()
        result = joined.groupBy("name").count()
        result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_take_one_exchange_and_a_number_per_partition(spark, store):
    """Without broadcasts by size there is one exchange of the rows, that of the range sort, before they are written."""
    df, rows = skewed(spark)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        found = number_rows(df, ["k"], [F.col("v"), F.col("id")], store)
        found.write.format("noop").mode("overwrite").save()
        got = {r.id: r.position for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan
    groups = {}
    for i, k, v in rows:
        groups.setdefault(k, []).append((v, i))
    assert got == {i: p for g in groups.values() for p, (_, i) in enumerate(sorted(g), start=1)}


def test_positions_of_keys_that_begin_and_end_anywhere(spark, store):
    """Many partitions: keys inside one, keys over several, null keys, two key columns, one key, no row."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for seed, keys in enumerate([3, 40, 1, 5000]):
            rng = random.Random(seed)
            rows = [(i, rng.choice([None, *range(keys)]), rng.choice(["x", None])) for i in range(4000)]
            df = spark.createDataFrame(rows, "id bigint, a bigint, b string").repartition(4)
            groups = {}
            for i, a, b in rows:
                groups.setdefault((a, b), []).append(-i)
            want = {-i: p for g in groups.values() for p, i in enumerate(sorted(g), start=1)}
            got = number_rows(df, ["a", "b"], [F.desc("id")], store, "at").collect()
            assert {r["id"]: r["at"] for r in got} == want
        assert number_rows(df.limit(0), ["a"], [F.col("id")], store).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
