"""Coupon arithmetic in whole New Taiwan dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coupon_discount(price: Column, min_spend: Column, kind: Column, value: Column) -> Column:
    """Discount a coupon gives on ``price``; integers throughout, never more than the price."""
    price, value = price.cast("bigint"), value.cast("bigint")
    # Integer division truncates toward zero, and no double is involved.
    percent = F.call_function("div", price * value, F.lit(100).cast("bigint"))
    granted = F.when(kind == "amount", value).when(kind == "percent", percent).otherwise(F.lit(0))
    return (
        F.when(price < min_spend.cast("bigint"), F.lit(0))
        .otherwise(F.least(granted, price))
        .cast("bigint")
    )


def coupon_usable(
    at: Column,
    is_active: Column,
    start: Column,
    end: Column,
    usage_limit: Column,
    uses: Column,
) -> Column:
    """Whether a coupon may be used at time ``at``; both ends of its period count, limit 0 is no limit."""
    return is_active & (start <= at) & (at <= end) & ((usage_limit == 0) | (uses < usage_limit))
