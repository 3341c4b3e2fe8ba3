"""Columns reached over foreign keys, such as the user name of a cart item's cart.

A path is a tuple of foreign keys ending in a column: ``("cart_id", "user_id", "username")``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import table
from ..shop import Shop

Path = tuple[str, ...]


def restrict(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose id is in ``ids``, a frame of at most one page of rows (hence the broadcast)."""
    if ids is None:
        return df
    return df.join(F.broadcast(ids), F.col("id") == F.col("_wanted"), "left_semi")


def columns_over(
    shop: Shop, name: str, paths: Mapping[str, Path], ids: DataFrame | None = None
) -> DataFrame:
    """Table ``name`` as (id, one column per path).

    Required keys are joined inner, nullable ones left: a missing parent gives null and never
    drops the row. With ``ids`` only those rows, and only their parents, are looked up.
    """
    own = {alias: path[0] for alias, path in paths.items() if len(path) == 1}
    over: dict[str, dict[str, Path]] = defaultdict(dict)
    for alias, path in paths.items():
        if len(path) > 1:
            over[path[0]][alias] = path[1:]

    rows = restrict(shop[name], ids)
    result = rows.select(
        "id",
        *[F.col(key).alias(f"_fk_{key}") for key in over],
        *[F.col(column).alias(alias) for alias, column in own.items()],
    )
    for key, sub_paths in over.items():
        foreign = table(name)[key]
        parent_ids = None
        if ids is not None:
            parent_ids = rows.select(F.col(key).alias("_wanted"))
        parent = columns_over(shop, foreign.refers_to, sub_paths, parent_ids)
        parent = parent.withColumnRenamed("id", f"_fk_{key}")
        result = result.join(parent, f"_fk_{key}", "left" if foreign.null else "inner")
    return result.select("id", *paths)
