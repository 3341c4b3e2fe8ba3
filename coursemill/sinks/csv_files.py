"""CSV in the dialect of the shop's exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import iso_text

BOM = "﻿"


def as_csv_text(df: DataFrame) -> DataFrame:
    """Every column as the text the export shows: True/False, UTC times with offset, '' for null."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            column = F.initcap(column.cast("string"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = iso_text(column)
        else:
            column = column.cast("string")
        columns.append(F.coalesce(column, F.lit("")).alias(f.name))
    return df.select(*columns)


def _quoted(text: Column) -> Column:
    """Quotes only around fields that need them, quotes inside doubled."""
    needs = text.rlike('[",\r\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write an export: header and byte-order mark in each file, CRLF, quotes only where needed.

    Lines are made by expressions and written as text, because the csv sink turns a newline
    inside a field into the line separator. Files are written in parallel, each a complete csv
    file of its own; one holds the header alone, so an empty export has one too.
    ``single_file`` gathers the rows into one file and is meant for exports small enough for
    one task.
    """
    text = as_csv_text(df)
    header = BOM + ",".join(text.columns)
    line = F.concat_ws(",", *[_quoted(F.col(f"`{c}`")) for c in text.columns])
    header_only = df.sparkSession.createDataFrame([(header,)], "line string").coalesce(1)
    if single_file:
        # The id keeps the order of an ordered export; the header comes before all rows.
        rows = text.select(line.alias("line"), F.monotonically_increasing_id().alias("place"))
        both = header_only.withColumn("place", F.lit(-1).cast("bigint")).unionAll(rows)
        lines = both.coalesce(1).sortWithinPartitions("place").select("line")
    else:
        # The lower 33 bits of the generated id count the rows of a partition, i.e. of a file.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        rows = text.select(line.alias("line"), first.alias("first"))
        with_header = F.when(F.col("first"), F.array(F.lit(header), F.col("line"))).otherwise(F.array("line"))
        lines = header_only.unionAll(rows.select(F.explode(with_header).alias("line")))
    lines.write.option("lineSep", "\r\n").text(path)


def write_exports(exports: Mapping[str, DataFrame], folder: str, single_file: bool = False) -> None:
    """All exports, one sub-folder each."""
    for name, df in exports.items():
        write_csv(df, f"{folder}/{name}.csv", single_file)
