"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in VIEWS:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def _sorted_rows(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: [(v is not None, str(type(v)), str(v)) for v in r])


def difference(answer: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What is different between a query's rows and its SQL's, or None."""
    relation = connection.sql(sql)
    if sorted(answer.columns) != sorted(relation.columns):
        return f"columns {sorted(answer.columns)} and {sorted(relation.columns)}"
    for field in answer.schema.fields:
        kind = str(dict(zip(relation.columns, relation.types))[field.name])
        if not _same_kind(field.dataType.simpleString(), kind):
            return f"{field.name} is {field.dataType.simpleString()} and {kind}"
    ours = _sorted_rows([tuple(r) for r in answer.collect()], answer.columns)
    theirs = _sorted_rows(relation.fetchall(), relation.columns)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} and {b}"
    return None


_KINDS = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP"},
}


def _same_kind(spark_type: str, duckdb_type: str) -> bool:
    return duckdb_type in _KINDS.get(spark_type, {duckdb_type})
