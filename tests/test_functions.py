"""Scalar rules against plain Python over grids of values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from coursemill.functions import (
    code_label,
    contains_text,
    coupon_discount,
    coupon_usable,
    day_ranges,
    iso_text,
    json_text,
    one_decimal,
    strip,
    time_literal,
)
from coursemill.schema import LEVEL


def test_one_decimal_rounds_like_python(spark):
    pairs = [(s, n) for n in range(0, 121) for s in range(0, 6 * n + 1)] + [(65535 * 7 + 3, 20), (123457, 10)]
    rows = spark.createDataFrame(pairs, "total bigint, n bigint").select(
        "total", "n", one_decimal(F.col("total"), F.col("n")).alias("r")
    )
    for total, n, r in rows.collect():
        want = None if n == 0 else round(round(total / n + 1e-12, 4), 1)
        assert r == want, (total, n, r, want)


@pytest.mark.parametrize(
    "tie,want", [(1.15, 1.1), (1.25, 1.2), (1.35, 1.4), (2.65, 2.6), (4.85, 4.8), (4.75, 4.8), (0.25, 0.2), (7.45, 7.5)]
)
def test_ties_at_the_second_decimal(spark, tie, want):
    row = spark.range(1).select(one_decimal(F.lit(round(tie * 20)), F.lit(20)).alias("r")).first()
    assert row.r == round(tie, 1) == want


def python_discount(price, min_spend, kind, value):
    if price < min_spend:
        return 0
    given = {"amount": value, "percent": int(price * value / 100)}.get(kind, 0)
    return min(given, price)


def test_coupon_discount_over_a_grid(spark):
    grid = [
        (price, min_spend, kind, value)
        for price in (0, 1, 7, 99, 499, 500, 501, 1000, 1199, 1999, 2147483647)
        for min_spend in (0, 500, 1000)
        for kind in ("amount", "percent", "gift")
        for value in (0, 1, 15, 20, 33, 99, 100, 150, 3000)
    ]
    rows = spark.createDataFrame(grid, "price int, min_spend bigint, kind string, value bigint")
    got = rows.select(
        "*", coupon_discount(F.col("price"), F.col("min_spend"), F.col("kind"), F.col("value")).alias("d")
    )
    for row in got.collect():
        assert row.d == python_discount(row.price, row.min_spend, row.kind, row.value), row


def test_coupon_usable_at_both_ends_of_its_period(spark):
    rows = [
        ("2024-01-01 00:00:00", True, 0, 5, True),
        ("2024-01-31 00:00:00", True, 0, 5, True),
        ("2023-12-31 23:59:59", True, 0, 5, False),
        ("2024-01-31 00:00:01", True, 0, 5, False),
        ("2024-01-10 00:00:00", False, 0, 0, False),
        ("2024-01-10 00:00:00", True, 5, 4, True),
        ("2024-01-10 00:00:00", True, 5, 5, False),
    ]
    df = spark.createDataFrame(rows, "at string, active boolean, cap int, uses int, want boolean")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    usable = coupon_usable(
        F.col("at").cast("timestamp_ntz"), F.col("active"), start, end, F.col("cap"), F.col("uses")
    )
    assert df.filter(usable != F.col("want")).count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        strip(F.lit("　\t NEW100 \n")).alias("stripped"),
        contains_text(F.lit("100% Off_Now"), "% oFF_").alias("literal"),
        contains_text(F.lit("abc"), "%").alias("no_wildcard"),
        code_label(F.lit("advanced"), LEVEL).alias("known"),
        code_label(F.lit("expert"), LEVEL).alias("unknown"),
        json_text(F.lit('a"你\\')).alias("json"),
    ).first()
    assert tuple(row) == ("NEW100", True, False, "高階", "expert", '"a\\"你\\\\"')


def test_date_ranges_follow_the_shop_zone():
    ranges = day_ranges(datetime(2024, 1, 15, 20, 30))  # already the 16th in the shop
    assert ranges["today"][0].isoformat() == "2024-01-15T16:00:00+00:00"
    assert ranges["past_7_days"][0].isoformat() == "2024-01-08T16:00:00+00:00"
    assert ranges["past_7_days"][1].isoformat() == "2024-01-16T16:00:00+00:00"
    assert [d.isoformat()[:10] for d in ranges["this_month"]] == ["2023-12-31", "2024-01-31"]
    assert [d.isoformat()[:10] for d in ranges["this_year"]] == ["2023-12-31", "2024-12-31"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_text_and_literals_for_both_time_types(spark, kind):
    df = spark.sql(f"select cast('2024-05-06 07:08:09.000120' as {kind}) as t union all select cast('2024-05-06 07:08:09' as {kind})")
    assert sorted(r[0] for r in df.select(iso_text(F.col("t"))).collect()) == [
        "2024-05-06 07:08:09+00:00",
        "2024-05-06 07:08:09.000120+00:00",
    ]
    literal = time_literal(datetime(2024, 5, 6, 7, 8, 9), df.schema["t"].dataType)
    assert df.filter(F.col("t") == literal).count() == 1
