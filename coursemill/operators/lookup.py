"""Keyed look-ups and existence tests for a whole table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, **names: str) -> DataFrame:
    """Select ``source`` columns under new names: ``rename(users, user_id='id', username='username')``."""
    return df.select(*[F.col(source).alias(target) for target, source in names.items()])


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that meets the other by shuffle and sort, never by broadcast.

    For tables that grow with the shop. Spark guesses their rows from their files, and a guess under the threshold for
    broadcasts can be ten times too low; such a broadcast is built in the driver's memory. With the same kind of join
    at every size what is shuffled grows with the input, without a step at the threshold.
    """
    return df.hint("merge")


def only_existing(requests: DataFrame, facts: DataFrame, on: dict[str, str]) -> DataFrame:
    return _exists(requests, facts, on, "left_semi")


def only_missing(requests: DataFrame, facts: DataFrame, on: dict[str, str]) -> DataFrame:
    return _exists(requests, facts, on, "left_anti")


def _exists(requests: DataFrame, facts: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    keys = facts.select(*[F.col(f).alias(f"_{f}") for f in on.values()])
    match: Sequence[Column] = [F.col(r) == F.col(f"_{f}") for r, f in on.items()]
    return requests.join(keys, list(match), how)
