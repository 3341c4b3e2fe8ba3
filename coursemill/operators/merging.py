"""Set-based versions of get-or-create, update-or-create and set replacement.

A request's or a feed's id tells its place in the order, never the id of the row it makes: new rows take the
table's highest id plus their number, as a table that hands out ids would give them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store
from .numbering import number_rows, one_per_key


def with_new_ids(existing: DataFrame, new: DataFrame, order: Sequence[str], store: Store) -> DataFrame:
    """``new`` with ids that follow the highest of ``existing``, in ``order`` (which must have no ties)."""
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(new, [], [F.col(c) for c in order], store, "_number")
    columns = dict.fromkeys(["id", *new.columns])
    return numbered.select(*[(highest + F.col("_number")).alias("id") if c == "id" else F.col(c) for c in columns])


def absent(existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` yet, the first by ``order`` for each key."""
    first = one_per_key(new, key, order)
    return first.join(existing.select(*key), list(key), "left_anti").select(*new.columns)


def insert_if_absent(
    existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], store: Store
) -> DataFrame:
    """``existing`` plus the rows of ``new`` that bring a new natural key, under new ids in ``order``."""
    created = with_new_ids(existing, absent(existing, new, key, order), order, store)
    return existing.unionByName(created, allowMissingColumns=True)


def set_difference_plan(current: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """What to do to turn ``current`` into ``wanted``: one ('add' | 'drop', key) row per change."""
    current, wanted = current.select(*key), wanted.select(*key).distinct()
    added = wanted.join(current, list(key), "left_anti").select(F.lit("add").alias("action"), *key)
    dropped = current.join(wanted, list(key), "left_anti").select(F.lit("drop").alias("action"), *key)
    return added.unionAll(dropped)


def upsert(
    existing: DataFrame,
    changes: DataFrame,
    key: str,
    overwrite: Mapping[str, Column],
    store: Store,
) -> DataFrame:
    """Update the rows of ``existing`` named by ``key``, append the rest of ``changes``.

    ``changes`` has one row per key; its ``id`` gives the order in which new rows get ids. ``overwrite`` gives, per column, the expression for an
    updated row in terms of ``old.<column>`` and ``new.<column>``. Should several existing rows
    share a key, the one with the lowest id is updated. Both joins are on unique keys.
    """
    targets = existing.groupBy(key).agg(F.min("id").alias("_target"))
    known = changes.join(targets, key).drop("id").alias("new")
    updated = (
        existing.alias("old")
        .join(known, F.col("old.id") == F.col("_target"), "left")
        .select(
            *[
                F.when(F.col("_target").isNotNull(), overwrite[c])
                .otherwise(F.col(f"old.{c}"))
                .alias(c)
                if c in overwrite
                else F.col(f"old.{c}").alias(c)
                for c in existing.columns
            ]
        )
    )
    created = changes.join(targets, key, "left_anti").select(*existing.columns)
    return updated.unionByName(with_new_ids(existing, created, ["id"], store))
