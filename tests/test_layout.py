"""Deep pages and bucketed order tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coursemill.operators import browse as browsing
from coursemill.plans import exports
from coursemill.sources.layout import ORDER_KEY, save_bucketed, with_bucketed
from tests.test_operators import plain


@pytest.mark.parametrize("page", [0, 1, 40])
def test_pages_come_newest_first(shop, store, page):
    ids = sorted((r["id"] for r in shop["order_items"].select("id").collect()), reverse=True)
    shown = [r["id"] for r in browsing.browse(shop, "order_items", store, page=page).collect()]
    assert shown == ids[page * 100 : page * 100 + 100] and shown


def test_there_is_nothing_after_the_last_page(shop, store):
    assert browsing.browse(shop, "orders", store, page=1000).count() == 0


@pytest.fixture(scope="module")
def bucketed(spark, shop, store):
    save_bucketed(shop, store.fresh_path("buckets"), "bucketed_", buckets=8)
    yield with_bucketed(spark, shop, "bucketed_")
    for name in ORDER_KEY:
        spark.sql(f"drop table bucketed_{name}")


@pytest.mark.parametrize("name", ["order_items", "payments", "coupon_usage"])
def test_bucketed_tables_give_the_same_exports(shop, bucketed, name):
    assert plain(exports.EXPORTS[name](bucketed)) == plain(exports.EXPORTS[name](shop))


def test_order_joins_on_buckets_do_not_shuffle(spark, bucketed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bucketed["payments"].join(
            bucketed["orders"].select(F.col("id").alias("order_id"), "user_id"), "order_id"
        )
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        shuffled = exports.export_payments(bucketed)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in shuffled.splitlines() if "Exchange" in line and "payment" in line.lower()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _orders_with_ids(spark, shop, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    order = shop["orders"].limit(1).drop("id")
    return shop.replace(orders=rows.crossJoin(order).repartition(4).select(*shop["orders"].columns))


SPREADS = {
    "dense": range(1, 1000),
    "gaps": [*range(5, 250), 10**6, *range(10**12, 10**12 + 130), 2**61],
    "two heaps": [*range(-(2**62), -(2**62) + 400), *range(2**62, 2**62 + 400)],
    "one": [7],
    "none": [],
    "without ids": [None, None, None, *range(95)],
    "only without": [None] * 120,
}


@pytest.mark.parametrize("spread", SPREADS)
def test_pages_of_any_ids(spark, shop, store, monkeypatch, spread):
    """With few ranges and few rows to sort, histograms are refined several times; no row is lost or comes twice."""
    monkeypatch.setattr(browsing, "BINS", 7)
    monkeypatch.setattr(browsing, "FEW", 30)
    ids = list(SPREADS[spread])
    few = _orders_with_ids(spark, shop, ids)
    want = sorted((i for i in ids if i is not None), reverse=True) + [None] * ids.count(None)
    for page in (0, 1, 2, 9):
        shown = browsing._page(few, "orders", few["orders"].select("id", "status"), page).collect()
        assert [r["id"] for r in shown] == want[page * 100 : page * 100 + 100]


def test_a_page_is_found_by_counts_and_a_range_of_ids(shop, store, monkeypatch):
    """Histograms are small, the ids' range reaches the scan, and no row is shuffled for the page."""
    rows = shop["order_items"]
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    counts = browsing.IdCounts(rows.select("id"), low, high)
    assert counts.total() == rows.count() and len(counts.histogram(low, high)) <= browsing.BINS
    monkeypatch.setattr(browsing, "FEW", 200)
    page = browsing._page(shop, "order_items", rows, 3)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan
