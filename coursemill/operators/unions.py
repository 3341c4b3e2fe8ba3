"""Unions of many frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames. Pairs are united in a balanced tree: each step analyses the plan
    below it again, so a chain would analyse the first frames many times over."""
    level = list(frames)
    while len(level) > 1:
        pairs = [a.unionAll(b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]
