"""Stored layout for the tables that hang on an order.

Order items, payments, coupon usages and refunds meet their order by its id in every export,
label and deletion. Written in buckets of that id, both sides of these joins are in place
and the fact tables are not shuffled. An order has few rows in each table, so buckets stay
even; keys that may be hot (course, user, coupon) are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shop import Shop

ORDER_KEY = {
    "orders": "id",
    "order_items": "order_id",
    "payments": "order_id",
    "coupon_usages": "order_id",
    "refunds": "order_id",
}


def save_bucketed(shop: Shop, folder: str, prefix: str, buckets: int = 1024) -> None:
    """Write the order tables as bucketed, sorted catalogue tables ``<prefix><table>`` under ``folder``.

    Rows are first partitioned like the buckets, so each bucket is one file.
    """
    for name, key in ORDER_KEY.items():
        (
            shop[name]
            .repartition(buckets, key)
            .write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", f"{folder}/{name}")
            .mode("overwrite")
            .saveAsTable(f"{prefix}{name}")
        )


def with_bucketed(spark: SparkSession, shop: Shop, prefix: str) -> Shop:
    """The same shop reading its order tables from the buckets."""
    tables: dict[str, DataFrame] = {name: spark.table(f"{prefix}{name}") for name in ORDER_KEY}
    return shop.replace(**tables)
