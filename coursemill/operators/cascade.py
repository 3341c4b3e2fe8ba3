"""Deleting rows together with everything that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CASCADE, SET_NULL, TABLES, Table, table
from ..shop import Shop
from ..store import Store
from .unions import union_all


class Deletion:
    """The effect of deleting rows of one table on all tables.

    ``marked(t)`` is table ``t`` with the nullable keys already cleared and two flags: ``_gone``
    for rows that are deleted, ``_cleared`` for rows that lose a reference. Every edge of the
    key graph is one left join against distinct ids; the graph has no cycles, so following it
    upwards ends. Deleted ids of a table that others depend on are written once, when first needed.
    """

    def __init__(self, shop: Shop, root: str, ids: DataFrame, store: Store):
        self.shop = shop
        self.root = root
        self.store = store
        self._marked: dict[str, DataFrame] = {}
        self._ids: dict[str, DataFrame] = {root: store.keep(ids.select("id").distinct(), "deleted")}

    def _affected(self, name: str) -> bool:
        """Whether rows of this table can be deleted at all."""
        return name == self.root or any(
            c.on_delete == CASCADE and self._affected(c.refers_to) for c in table(name).foreign_keys
        )

    def _deleted_ids(self, name: str) -> DataFrame:
        if name not in self._ids:
            gone = self.marked(name).filter("_gone").select("id")
            self._ids[name] = self.store.keep(gone, f"deleted-{name}")
        return self._ids[name]

    def marked(self, name: str) -> DataFrame:
        if name not in self._marked:
            self._marked[name] = self._mark(table(name))
        return self._marked[name]

    def _mark(self, t: Table) -> DataFrame:
        df = self.shop[t.name]
        columns = {c: c for c in df.columns}
        gone, cleared = [], []
        edges = [("id", self.root, CASCADE)] if t.name == self.root else []
        edges += [(c.name, c.refers_to, c.on_delete) for c in t.foreign_keys]
        for key, parent, on_delete in edges:
            if key not in columns or not self._affected(parent):
                continue
            dead = f"_dead_{key}"
            ids = self._deleted_ids(parent).select(F.col("id").alias(dead))
            df = df.join(ids, F.col(key) == F.col(dead), "left")
            if on_delete == CASCADE:
                gone.append(f"{dead} is not null")
            elif on_delete == SET_NULL:
                columns[key] = f"if({dead} is null, {key}, null)"
                cleared.append(f"{dead} is not null")
        is_gone, is_cleared = (" or ".join(tests) or "false" for tests in (gone, cleared))
        return df.selectExpr(
            *[f"{value} as {name}" for name, value in columns.items()],
            f"{is_gone} as _gone",
            f"({is_cleared}) and not ({is_gone}) as _cleared",
        )

    def remaining(self, name: str) -> DataFrame:
        """What is left of a table."""
        return self.marked(name).filter(~F.col("_gone")).drop("_gone", "_cleared")

    def counts(self) -> DataFrame:
        """Rows before, rows left and references cleared, for every table, one pass each."""
        frames = [
            df.agg(
                F.count(F.lit(1)).alias("rows_before"),
                F.count_if(~F.col("_gone")).alias("rows_left"),
                F.count_if(F.col("_cleared")).alias("rows_cleared"),
            ).select(F.lit(name).alias("table_name"), "rows_before", "rows_left", "rows_cleared")
            for name, df in ((name, self.marked(name)) for name in TABLES)
        ]
        return union_all(frames)


def courses_to_delete(shop: Shop, requests: DataFrame) -> DataFrame:
    """Ids of the requested courses ``(course_id, user_id)`` that belong to the requesting teacher."""
    teachers = shop["profiles"].filter(F.col("role") == "teacher").select("user_id")
    own = shop["courses"].select(F.col("id").alias("course_id"), F.col("teacher_id").alias("user_id"))
    return (
        requests.select("course_id", "user_id")
        .join(teachers, "user_id", "left_semi")
        .join(own, ["course_id", "user_id"], "left_semi")
        .select(F.col("course_id").alias("id"))
        .distinct()
    )


def delete_courses(shop: Shop, requests: DataFrame, store: Store) -> Deletion:
    return Deletion(shop, "courses", courses_to_delete(shop, requests), store)
