"""What the readers say of files before they read them, and what they count."""

from __future__ import annotations

from checks.derive import DEFINITIONS, derived
from coursemill import Shop
from coursemill.schema import TABLES
from coursemill.sources.readers import column_counts, column_findings
from tests.conftest import SMALL


def test_derived_tables_have_exactly_the_declared_columns(spark, store):
    for name in TABLES:
        assert f"lms_{name}" in DEFINITIONS
        path = store.fresh_path(name)
        derived(spark, SMALL, f"lms_{name}").limit(0).write.parquet(path)
        assert column_findings(spark, name, path) == [], name


def test_columns_that_depart_from_the_declared_ones_are_named(spark, store, shop):
    path = store.fresh_path("courses")
    courses = shop["courses"].drop("image", "level").selectExpr("*", "'x' as note").withColumn("price", shop["courses"]["price"].cast("string"))
    courses.write.parquet(path)
    assert column_findings(spark, "courses", path) == [
        ("image", "absent"),
        ("level", "absent"),
        ("note", "extra"),
        ("price", "is string, declared int"),
    ]
    as_csv = store.fresh_path("courses-csv")
    courses.write.option("header", True).csv(as_csv)
    assert column_findings(spark, "courses", as_csv, "csv") == [("image", "absent"), ("level", "absent"), ("note", "extra")]


def test_values_of_every_column_are_counted(spark):
    users = spark.createDataFrame([(1, "a", None), (2, None, None)], "id bigint, username string, `odd name` string")
    none = spark.createDataFrame([], "id bigint")
    found = {(r.table_name, r.column_name): r.n_values for r in column_counts(Shop.of(users=users, carts=none)).collect()}
    assert found == {("users", "id"): 2, ("users", "username"): 1, ("users", "odd name"): 0, ("carts", "id"): 0}
