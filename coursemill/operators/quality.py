"""Checks of the tables against their declared constraints.

Every check gives one row per violation: (rule, table_name, column_name, id). Tables without an id are checked
as well; their violations have a null id, and a repeated key is one violation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import WHITESPACE
from ..schema import Table, table
from ..shop import Shop
from ..store import Store
from .unions import union_all

# Deliberately simple shapes: something@host.tld, and a web or ftp address with a host.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^(?i:https?|ftps?)://[^\s/?#]+\S*$",
}

ROW_RULES = ("choices", "non_negative", "max_length", "required", "formats", "order_arithmetic")


def _row_tests(t: Table, present: set[str]) -> Iterable[tuple[str, str, str]]:
    """(rule, column, SQL condition that is true for a violation)."""
    for c in t.columns:
        if c.name not in present:
            continue
        if c.choices:
            yield "choices", c.name, f"{c.name} not in ({', '.join(repr(code) for code in c.choices)})"
        if c.non_negative:
            yield "non_negative", c.name, f"{c.name} < 0"
        if c.max_length:
            yield "max_length", c.name, f"char_length({c.name}) > {c.max_length}"
        if not c.null:
            blank = f" or btrim({c.name}, '{WHITESPACE}') = ''" if c.kind == "text" and not c.blank else ""
            yield "required", c.name, f"{c.name} is null{blank}"
        if c.shape:
            yield "formats", c.name, f"{c.name} <> '' and not rlike({c.name}, r'{SHAPES[c.shape]}')"
    if t.name == "orders":
        yield "order_arithmetic", "final_price", "final_price <> original_price - discount_amount"
        yield "order_arithmetic", "discount_amount", "discount_amount > original_price"


def concerned(names: Iterable[str], rules: Sequence[str]) -> list[str]:
    """Those of the named tables for which one of the rules is declared; the others need not be read."""

    def declared(t: Table) -> set[str]:
        keys = {"unique" if len(key) == 1 else "unique_pairs" for key in t.unique}
        of_rows = {rule for rule, _, _ in _row_tests(t, {c.name for c in t.columns})}
        return keys | of_rows | ({"one_to_one"} if t.one_to_one else set())

    return [name for name in names if not declared(table(name)).isdisjoint(rules)]


def _with_id(df: DataFrame) -> DataFrame:
    return df if "id" in df.columns else df.withColumn("id", F.lit(None).cast("bigint"))


def absent_columns(name: str, df: DataFrame) -> list[DataFrame]:
    """One row, with a null id, for every declared column that the table does not have."""
    absent = [(c.name,) for c in table(name).columns if c.name not in df.columns]
    if not absent:
        return []
    found = df.sparkSession.createDataFrame(absent, "column_name string")
    return [found.selectExpr("'columns' as rule", f"'{name}' as table_name", "column_name", "cast(null as bigint) as id")]


def row_violations(name: str, df: DataFrame, rules: Sequence[str] = ROW_RULES) -> list[DataFrame]:
    """All single-row rules of a table in one scan without a shuffle; nothing if no rule applies."""
    present = set(df.columns)
    tests = [
        f"if({test}, named_struct('rule', '{rule}', 'column_name', '{column}'), null)"
        for rule, column, test in _row_tests(table(name), present)
        if rule in rules
    ]
    if not tests:
        return []
    found = _with_id(df).selectExpr("id", f"explode(array_compact(array({', '.join(tests)}))) as v")
    return [found.selectExpr("v.rule", f"'{name}' as table_name", "v.column_name", "id")]


def repeated_keys(
    name: str, df: DataFrame, key: Sequence[str], rule: str, fold_case: Sequence[str] = ()
) -> DataFrame:
    """Rows that repeat the key of a row with a lower id: those an insert would have refused.

    Without an id, a key that repeats is reported once.

    Keys are counted with map-side combine; only keys that do repeat go back to the rows.
    """
    columns = {f"_k{i}": F.lower(F.col(k)) if k in fold_case else F.col(k) for i, k in enumerate(key)}
    found = [F.lit(rule).alias("rule"), F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("column_name"), F.col("id")]
    keyed = _with_id(df).select("id", *[c.alias(a) for a, c in columns.items()])
    for a in columns:
        keyed = keyed.filter(F.col(a).isNotNull())
    repeated = (
        keyed.groupBy(*columns)
        .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    if "id" not in df.columns:
        return _with_id(repeated).select(*found)
    return (
        keyed.join(repeated, list(columns))
        .filter(F.col("id") > F.col("_first"))
        .select(*found)
    )


UNIQUE_RULES = ("unique", "unique_pairs", "one_to_one")


def unique_violations(
    name: str, df: DataFrame, rules: Sequence[str] = UNIQUE_RULES
) -> list[DataFrame]:
    t = table(name)
    keys = [("unique" if len(key) == 1 else "unique_pairs", key) for key in t.unique]
    keys += [("one_to_one", (key,)) for key in t.one_to_one]
    return [
        repeated_keys(name, df, key, rule, t.case_insensitive) for rule, key in keys if rule in rules
    ]


VIOLATION = "rule string, table_name string, column_name string, id bigint"
#: Foreign keys to one parent that fit into the bits of a long beside the one for the parent's own ids.
MOST_KEYS = 62


def _key_values(df: DataFrame, keys: Sequence[tuple[int, str]], *more: str) -> DataFrame:
    """One row per foreign key that is not null: its number, its value, and the columns ``more``."""
    pairs = [f"named_struct('key', {n}, 'value', cast({c} as bigint))" for n, c in keys]
    return df.selectExpr(*more, f"inline(array({', '.join(pairs)}))").filter("value is not null")


def _dangling(ids: Sequence[DataFrame], values: Sequence[DataFrame]) -> DataFrame:
    """The different ``(parent, value, bit)`` of ``values`` without a row ``(parent, value)`` in ``ids``.

    Ids and key values are one aggregation: a value's bits say which keys hold it, the lowest that the parent has it.
    Unlike an anti-join, which Spark moves below a ``distinct``, it puts equal values together before the exchange.
    """
    rows = [df.selectExpr("parent", "value", "1L as bits") for df in ids]
    rows += [df.selectExpr("parent", "value", "shiftleft(1L, bit) as bits") for df in values]
    met = union_all(rows).groupBy("parent", "value").agg(F.bit_or("bits").alias("bits")).filter("getbit(bits, 0) = 0")
    return met.selectExpr("parent", "value", f"explode(filter(sequence(1, {MOST_KEYS}), b -> getbit(bits, b) = 1)) as bit")


def foreign_key_violations(shop: Shop, store: Store, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of the named tables, or of all, with a foreign key that names no parent.

    Every table is read once for the values of all its keys. Equal values are put together before the only
    exchange, so a hot parent costs one row per task, and the values of all tables meet the ids of all parents in
    one aggregation. The values that dangle are written; only tables that hold one are read again, to find the rows, and
    the written files tell their size, by which they are broadcast or not.
    """
    keys: dict[int, tuple[str, str, str]] = {}
    for name in names or list(shop):
        for c in table(name).foreign_keys:
            if c.name in shop[name].columns:
                keys[len(keys)] = name, c.name, c.refers_to
    nothing = store.spark.createDataFrame([], VIOLATION)
    if not keys:
        return nothing

    def of(name: str, among: Iterable[int]) -> list[tuple[int, str]]:
        return [(n, keys[n][1]) for n in among if keys[n][0] == name]

    children = dict.fromkeys(name for name, _, _ in keys.values())
    # Beyond MOST_KEYS, the keys to a parent go on in another group of bits, with the parent's ids again.
    to_parent: dict[str, list[int]] = {}
    for n, (_, _, parent) in keys.items():
        to_parent.setdefault(parent, []).append(n)
    groups = [(p, own[i : i + MOST_KEYS]) for p, own in to_parent.items() for i in range(0, len(own), MOST_KEYS)]
    place = {n: (g, bit) for g, (_, own) in enumerate(groups) for bit, n in enumerate(own, 1)}

    def values(name: str) -> DataFrame:
        pairs = [
            f"named_struct('parent', {place[n][0]}, 'value', cast({c} as bigint), 'bit', {place[n][1]})"
            for n, c in of(name, keys)
        ]
        return shop[name].selectExpr(f"inline(array({', '.join(pairs)}))").filter("value is not null")

    ids = [shop[p].selectExpr(f"{g} as parent", "cast(id as bigint) as value") for g, (p, _) in enumerate(groups)]
    number = F.create_map(*[x for n, (g, bit) in place.items() for x in (F.lit(g * 64 + bit), F.lit(n))])
    dangling = _dangling(ids, [values(name) for name in children])
    found = store.keep(dangling.select(number[F.col("parent") * 64 + F.col("bit")].alias("key"), "value"), "dangling")
    # At most one row per declared foreign key.
    broken = sorted(r.key for r in found.select("key").distinct().collect())
    frames = [nothing]
    for name in dict.fromkeys(keys[n][0] for n in broken):
        own = of(name, broken)
        rows = _key_values(_with_id(shop[name]), own, "id")
        labels = F.create_map(*[F.lit(v) for pair in own for v in pair])
        frames.append(
            rows.join(found.filter(F.col("key").isin([n for n, _ in own])), ["key", "value"], "left_semi").select(
                F.lit("foreign_keys").alias("rule"),
                F.lit(name).alias("table_name"),
                labels[F.col("key")].alias("column_name"),
                F.col("id").cast("bigint").alias("id"),
            )
        )
    return union_all(frames)


def validate(shop: Shop, names: Sequence[str] | None = None, store: Store | None = None) -> DataFrame:
    """Every violation of every rule in the named tables, or in all."""
    frames: list[DataFrame] = []
    names = names or list(shop)
    for name in names:
        df = shop[name]
        frames += [*absent_columns(name, df), *row_violations(name, df), *unique_violations(name, df)]
    store = store or Store(shop[names[0]].sparkSession)
    return union_all([*frames, foreign_key_violations(shop, store, names)])
