"""Every registered query against its SQL, and what its plan must not contain."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference
from checks.oracles import all_oracles
from checks.queries import all_queries
from tests.conftest import SMALL

# No row of the small data breaks these rules, or has such a page.
EMPTY: set[str] = set()
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_the_entry_query_runs(spark):
    assert driver.entry(spark).count() == 200


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    answer = QUERIES[name](spark, SMALL)
    plan = answer._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert unwanted not in plan
    if name in ORACLES:
        assert difference(answer, duck, ORACLES[name]) is None
        assert name in EMPTY or not answer.isEmpty()


@pytest.mark.parametrize("name", ["user_upsert", "course_upsert", "review_upsert", "insert_if_absent", "checkout_enrollments"])
def test_resulting_tables_have_unique_ids(name, spark):
    answer = QUERIES[name](spark, SMALL)
    assert answer.count() == answer.select("id").distinct().count() > 0


@pytest.mark.parametrize(
    "name, table",
    [("register_users", "users"), ("register_profiles", "profiles"), ("watch_log", "learning_records"), ("course_drafts", "courses"),
     ("planned_orders", "orders"), ("planned_enrollments", "enrollments")],
)
def test_new_rows_take_free_ids(name, table, spark, shop):
    new = QUERIES[name](spark, SMALL).select("id")
    assert new.count() == new.distinct().count() > 0
    assert new.join(shop[table].select("id"), "id").isEmpty()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["course_scorecard"](spark, SMALL)._jdf.queryExecution().toString()
    assert "EqualTo(status,paid)" in plan
    assert "ReadSchema: struct<course_id:bigint,minutes:bigint>" in plan
    assert "ReadSchema: struct<course_id:bigint,rating:int>" in plan
    pushed = QUERIES["browse_orders"](spark, SMALL)
    assert pushed.columns[0] == "id"
