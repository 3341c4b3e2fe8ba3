"""Typed readers for the shop's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.unions import union_all
from ..schema import TABLES, table
from ..shop import Shop

CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def read_table(spark: SparkSession, name: str, path: str, file_format: str = "parquet") -> DataFrame:
    """One table with its declared schema; nothing is inferred."""
    reader = spark.read.schema(table(name).struct)
    if file_format == "csv":
        return reader.options(**CSV_OPTIONS).csv(path)
    if file_format != "parquet":
        raise ValueError(f"tables are read from parquet or csv, not {file_format}")
    return reader.parquet(path)


def read_shop(spark: SparkSession, folder: str, file_format: str = "parquet") -> Shop:
    """A shop over ``folder/<table>``, one sub-folder or file per table."""
    return Shop(lambda name: read_table(spark, name, f"{folder}/{name}", file_format))


def read_jdbc(
    spark: SparkSession,
    name: str,
    url: str,
    source_table: str,
    lower_id: int,
    upper_id: int,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """One table of a live database, read in parallel ranges of its first key column and cast to its schema."""
    rows = spark.read.jdbc(
        url,
        source_table,
        column=table(name).columns[0].name,
        lowerBound=lower_id,
        upperBound=upper_id,
        numPartitions=partitions,
        properties={k: str(v) for k, v in options.items()},
    )
    return rows.select(*[rows[c.name].cast(c.spark_type).alias(c.name) for c in table(name).columns])


def read_feed(
    spark: SparkSession, schema: T.StructType, folder: str, files: str = "*.parquet", per_batch: int = 1000
) -> DataFrame:
    """A folder of arriving parquet files as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def row_counts(shop: Shop) -> DataFrame:
    """Number of rows of every table; parquet answers these from its footers."""
    counts = [
        shop[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in shop
        if name in TABLES
    ]
    return union_all(counts)


def column_counts(shop: Shop) -> DataFrame:
    """Values that are not null in every column of every table: one aggregation per table, map-side combined."""
    counts = []
    for name in shop:
        columns = shop[name].columns
        totals = shop[name].agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(columns)]
        counts.append(totals.select(F.lit(name).alias("table_name"), F.inline(F.array(*pairs))))
    return union_all(counts)


def column_findings(spark: SparkSession, name: str, path: str, file_format: str = "parquet") -> list[tuple[str, str]]:
    """How the files of a table depart from its declared columns, from their schema alone, before any row is read.

    (column, finding) pairs: ``absent`` (declared, not in the files), ``extra`` (in the files, not declared) and
    ``is <type>, declared <type>``. Columns of csv files are named by the header and have no types.
    """
    if file_format == "csv":
        found = spark.read.options(**CSV_OPTIONS).csv(path).schema
    else:
        found = spark.read.format(file_format).load(path).schema
    declared = {c.name: c.spark_type for c in table(name).columns}
    there = {f.name: f.dataType for f in found.fields}
    findings = [(c, "absent") for c in declared if c not in there]
    findings += [(c, "extra") for c in there if c not in declared]
    for c, kind in declared.items():
        if file_format != "csv" and c in there and there[c] != kind:
            findings.append((c, f"is {there[c].simpleString()}, declared {kind.simpleString()}"))
    return sorted(findings)
