"""Connected components of a table of links, by alternating large and small stars.

Every step replaces links by links to smaller neighbours and is one aggregation and one join, so a node with
very many links costs one row per task in the aggregation and is split by adaptive execution in the join.
The links of a step are written before the next one; the number of steps is logarithmic in practice. It ends when
only stars are left, which takes one aggregation to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.store import Store


def components(links: DataFrame, store: Store) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node in ``links`` (a, b).

    Links may repeat, have either direction or join a node to itself; nodes without links do not occur.
    """
    a, b = F.col("a"), F.col("b")
    ordered = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current = store.keep(ordered.filter("a <> b").distinct(), "links")
    while not _only_stars(current):
        both = current.select("a", "b").unionAll(current.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(b.alias("a"), F.col("m").alias("b"))
        large = store.keep(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b")))
        current = store.keep(small.distinct(), "small-star")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _only_stars(links: DataFrame) -> bool:
    """Whether every larger node has one link and is the smaller node of none: then all links lead to roots."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up = 1 and down = 1)").count() == 0
