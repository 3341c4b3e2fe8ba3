"""Exact duplicates: rows grouped by a 128-bit hash of the normalised text, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sha256(text: Column) -> Column:
    """Never null, and said so: else a join on it tests the whole expression for null first, at its full cost."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def duplicate_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hashed: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Groups are formed on (hash, text): the hash deals the rows out, and inside one hash Spark compares the
    texts byte by byte, so a collision makes two groups. Copies are put together before they are shuffled:
    a group with a third of all rows sends one row per task. The rows then find their group by the hash
    and the digest, without text; a hot group is one row on the other side, and adaptive execution splits
    the rows that look for it.

    Null and empty texts are one group, that of the empty text. Of equal texts the smallest id stays; a
    null id comes after all others. Rows that repeat an id with its text share ``kept``. Other columns of
    ``docs`` are left alone, whatever they are called; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("_id"), normalised(F.col(text_column)).alias("_text"))
    rows = rows.withColumn("_hash", F.coalesce(hashed(F.col("_text")), F.lit(b"")))
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", sha256(F.col("_text")).alias("text_sha256"), "keep_id", "group_size")
    )
    return (
        rows.select("_id", "_hash", sha256(F.col("_text")).alias("text_sha256"))
        .join(groups, ["_hash", "text_sha256"])
        .select(
            F.col("_id").alias(id_column),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; a row that repeats an id with its text stays once.

    The rows that stay are picked by id and digest. Rows are moved once, dealt out by these two, so that the
    copies of a text with very many of them go to different tasks and repeated rows meet. Other columns come
    through, whatever they are called; an empty table gives an empty result.
    """
    key = ["_id_text", "_no_id", "_digest"]

    def keyed(frame: DataFrame, digest: Column) -> list[Column]:
        ids = frame[id_column]
        text = F.coalesce(ids.cast("string"), F.lit(""))
        return [c.alias(k) for k, c in zip(key, (text, ids.isNull(), digest))]

    stay = duplicate_groups(docs, id_column, text_column).filter("kept")
    stay = stay.select(*keyed(stay, F.col("text_sha256"))).distinct()
    marked = docs.select(F.struct("*").alias("row"), *keyed(docs, sha256(normalised(F.col(text_column)))))
    return marked.join(stay, key, "left_semi").dropDuplicates(key).select("row.*")
