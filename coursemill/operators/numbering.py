"""Positions and newest-first selections that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..store import Store


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    store: Store,
    name: str = "position",
) -> DataFrame:
    """Add the 1-based position of each row within its ``keys`` group, in ``order``.

    ``row_number() over (partition by keys)`` would send a hot group to a single task.
    Here rows are dealt out by ranges of (keys, order), which cuts even one group into many partitions, and
    written once in buckets of the partition, because the bounds come from sampling. Reading the buckets, rows
    are numbered inside each partition without being moved again. Only the first key of a partition continues
    an earlier one, so one number per partition is carried over: as many as there are partitions.
    ``order`` has to be total, or the result is arbitrary among ties. With no ``keys`` the whole table is numbered.
    """
    dealt = df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys], *order)
    placed = store.keep_bucketed(dealt.withColumn("_part", F.spark_partition_id()), f"numbered-{name}", "_part")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)).cast("bigint")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key.alias("key"), "_n")).alias("_last"))
    carried = _carried(ends.collect())  # one row per partition
    if carried:
        numbers = [carried.get(part, 0) for part in range(max(carried) + 1)]
        carry = F.coalesce(F.get(F.array(*map(F.lit, numbers)).cast("array<bigint>"), F.col("_part")), F.lit(0))
        # In the same order, the first key of a partition is numbered as the partition is.
        whole = Window.partitionBy("_part").orderBy(*[F.asc_nulls_first(k) for k in keys], *order)
        inside = inside + F.when(F.row_number().over(whole) == inside, carry).otherwise(F.lit(0))
    return placed.select(*df.columns, inside.alias(name))


def _carried(ends: list[Row]) -> dict[int, int]:
    """By partition that goes on with the key of the one before, the rows of that key so far."""
    carried, before, total = {}, None, 0
    for part, first, (last, n) in sorted(ends, key=lambda r: r["_part"]):
        goes_on = before is not None and first == before
        if goes_on:
            carried[part] = total
        total = n + (total if goes_on and first == last else 0)
        before = last
    return carried


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark infers a group limit from the filter, so every map task passes on at most ``n``
    rows per key and a hot key does not reach one task whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last. A plain aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
