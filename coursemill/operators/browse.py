"""Searchable, filterable, paged listing of a table, configured per table."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code_label, contains_text, day_ranges, time_literal
from ..schema import table
from ..shop import Shop
from ..store import Store
from .labels import label_frame
from .paths import Path, columns_over

PAGE_ROWS = 100


@dataclass(frozen=True)
class Listing:
    """What a table's list page shows, which columns a search looks at, and what can be filtered."""

    shown: tuple[str, ...]
    searched: tuple[Path, ...]
    filters: Mapping[str, Path]


def _listing(shown: str, searched: str, filters: str = "") -> Listing:
    paths = [tuple(p.split(".")) for p in searched.split()]
    by = {p: tuple(p.split(".")) for p in filters.split()}
    return Listing(tuple(shown.split()), tuple(paths), by)


# Columns shown, columns searched and filters of each list page.
LISTINGS: dict[str, Listing] = {
    "profiles": _listing("user_id role", "user_id.username", "role"),
    "categories": _listing("name created_at", "name"),
    "courses": _listing(
        "title teacher_id category_id price level is_published created_at",
        "title teacher_id.username category_id.name",
        "teacher_id category_id level is_published",
    ),
    "chapters": _listing(
        "course_id title sort_order created_at", "course_id.title title", "course_id"
    ),
    "lessons": _listing(
        "chapter_id title duration_minutes sort_order is_free_preview created_at",
        "chapter_id.course_id.title chapter_id.title title",
        "chapter_id.course_id is_free_preview",
    ),
    "enrollments": _listing(
        "student_id course_id purchased_at", "student_id.username course_id.title", "purchased_at"
    ),
    "learning_records": _listing(
        "user_id course_id lesson_id minutes watched_at",
        "user_id.username course_id.title lesson_id.title",
        "course_id watched_at",
    ),
    "coupons": _listing(
        "code name discount_type discount_value min_spend start_date end_date usage_limit is_active",
        "code name",
        "discount_type is_active",
    ),
    "user_coupons": _listing(
        "user_id coupon_id status received_at used_at",
        "user_id.username coupon_id.code",
        "status received_at",
    ),
    "promotions": _listing(
        "name discount_type discount_value start_date end_date is_active",
        "name",
        "discount_type is_active",
    ),
    "carts": _listing("user_id created_at updated_at", "user_id.username"),
    "cart_items": _listing(
        "cart_id course_id added_at", "cart_id.user_id.username course_id.title", "added_at"
    ),
    "orders": _listing(
        "user_id course_id original_price discount_amount final_price status created_at",
        "user_id.username course_id.title",
        "status created_at",
    ),
    "order_items": _listing(
        "order_id course_id price", "order_id.user_id.username course_id.title"
    ),
    "coupon_usages": _listing(
        "user_id coupon_id order_id discount_amount used_at",
        "user_id.username coupon_id.code order_id.course_id.title",
        "used_at",
    ),
    "payments": _listing(
        "order_id method amount status transaction_no paid_at created_at",
        "order_id.user_id.username transaction_no",
        "method status created_at",
    ),
    "refunds": _listing(
        "order_id user_id amount status created_at processed_at",
        "user_id.username order_id",
        "status created_at",
    ),
    "favorites": _listing(
        "user_id course_id created_at", "user_id.username course_id.title", "created_at"
    ),
    "reviews": _listing(
        "user_id course_id rating created_at updated_at",
        "user_id.username course_id.title comment",
        "rating created_at",
    ),
    "notifications": _listing(
        "user_id title is_read created_at",
        "user_id.username title content",
        "is_read created_at",
    ),
    "questions": _listing(
        "user_id course_id lesson_id title created_at",
        "user_id.username course_id.title title content",
        "course_id created_at",
    ),
    "answers": _listing(
        "question_id user_id created_at",
        "question_id.title user_id.username content",
        "created_at",
    ),
    "audits": _listing(
        "course_id reviewer_id status created_at reviewed_at",
        "course_id.title reviewer_id.username comment",
        "status created_at",
    ),
}


def search_words(term: str | None) -> list[str]:
    """Words of a search; a quoted phrase counts as one word."""
    found = re.findall(r"\"([^\"]+)\"|'([^']+)'|(\S+)", term or "")
    return list(dict.fromkeys(w for groups in found for w in groups if w))


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def search(shop: Shop, name: str, rows: DataFrame, term: str | None) -> DataFrame:
    """Rows where every word occurs in at least one searched column.

    Each parent table is reduced to the ids that contain some word plus one flag per word before
    it is joined, so no parent text travels with the rows and most parents shrink to a few ids.
    """
    words = search_words(term)
    if not words:
        return rows
    columns = rows.columns
    own: list[str] = []
    over: dict[str, list[Path]] = defaultdict(list)
    for path in LISTINGS[name].searched:
        if len(path) == 1:
            own.append(path[0])
        else:
            over[path[0]].append(path[1:])

    hits: list[list[Column]] = [[F.coalesce(contains_text(F.col(c), w), F.lit(False)) for c in own] for w in words]
    for key, paths in over.items():
        aliases = {f"_text{i}": path for i, path in enumerate(paths)}
        parent = columns_over(shop, table(name)[key].refers_to, aliases)
        flags = [
            F.coalesce(_either([F.coalesce(contains_text(F.col(a), w), F.lit(False)) for a in aliases]), F.lit(False))
            for w in words
        ]
        names = [f"_{key}_has{i}" for i in range(len(words))]
        parent = parent.select(
            F.col("id").alias(f"_{key}"), *[flag.alias(n) for flag, n in zip(flags, names)]
        ).filter(_either([F.col(n) for n in names]))
        rows = rows.join(parent, F.col(key) == F.col(f"_{key}"), "left")
        for tests, n in zip(hits, names):
            tests.append(F.coalesce(F.col(n), F.lit(False)))
    return rows.filter(reduce(lambda a, b: a & b, [_either(tests) for tests in hits])).select(*columns)


def apply_filters(
    shop: Shop, name: str, rows: DataFrame, filters: Mapping[str, object], now: datetime | None
) -> DataFrame:
    """Equality per filter, ``None`` for 'empty', and the named ranges of the date filters."""
    listing = LISTINGS[name]
    for label, wanted in filters.items():
        path = listing.filters[label]
        column = table(name)[path[0]]
        if len(path) > 1:
            parent_name = column.refers_to
            parents = shop[parent_name].filter(F.col(path[1]) == F.lit(wanted))
            rows = rows.join(parents.select(F.col("id").alias("_p")), F.col(path[0]) == F.col("_p"), "left_semi")
        elif wanted is None:
            rows = rows.filter(F.col(path[0]).isNull())
        elif column.kind == "time":
            if now is None:
                raise ValueError("date filters need the time they are relative to")
            first, end = day_ranges(now)[str(wanted)]
            kind = rows.schema[path[0]].dataType
            rows = rows.filter(
                (F.col(path[0]) >= time_literal(first, kind)) & (F.col(path[0]) < time_literal(end, kind))
            )
        else:
            rows = rows.filter(F.col(path[0]) == F.lit(wanted))
    return rows


#: Ranges of ids that one histogram counts; rows around a page that are sorted rather than counted again.
BINS, FEW = 1000, 10_000


class IdCounts:
    """Counts of rows by range of ids: mergeable histograms, refined where a range holds too many rows.

    A histogram is one aggregation with map-side combine and has at most ``BINS`` rows. Each further one looks at
    a single range of the one before, which reaches the scan as a filter on the id.
    """

    def __init__(self, rows: DataFrame, low: int, high: int):
        self.rows, self.low, self.high = rows, low, high
        self.known: dict[tuple[int, int], dict[int, int]] = {}

    @staticmethod
    def width(low: int, high: int) -> int:
        return -(-(high - low + 1) // BINS)

    def histogram(self, low: int, high: int) -> dict[int, int]:
        """Rows by number of the range, from the highest ids down."""
        if (low, high) not in self.known:
            # In decimals, as ids may be as far apart as 64 bits allow.
            number = F.expr(f"(cast({high} as decimal(20, 0)) - id) div cast({self.width(low, high)} as decimal(20, 0))")
            counted = self.rows.filter(F.col("id").between(low, high)).groupBy(number.alias("_bin"))
            found = counted.agg(F.count(F.lit(1)).alias("_n")).collect()
            self.known[low, high] = {r["_bin"]: r["_n"] for r in sorted(found)}
        return self.known[low, high]

    def total(self) -> int:
        return sum(self.histogram(self.low, self.high).values())

    def around(self, place: int) -> tuple[int, int, int] | None:
        """(lowest id, highest id, rows above it) of a range with the row at ``place``, counted from the highest id.

        The range has at most ``FEW`` rows, or a single id.
        """
        low, high, above = self.low, self.high, 0
        while True:
            width = self.width(low, high)
            for number, n in self.histogram(low, high).items():
                if above + n > place:
                    high -= number * width
                    low = max(low, high - width + 1)
                    break
                above += n
            else:
                return None
            if n <= FEW or width == 1:
                return low, high, above


def _page(shop: Shop, name: str, rows: DataFrame, page: int) -> DataFrame:
    """Rows of one page, newest id first, those without an id last. Every page is found in the same way.

    The ids between which the page lies are read off counts; then one scan of these ids alone brings the page. No row
    is shuffled before that, and nothing is written, so a page far back costs what the first one costs.
    """
    skipped = page * PAGE_ROWS
    without = rows.filter(F.col("id").isNull())
    low, high = shop[name].agg(F.min("id"), F.max("id")).first()
    if low is None:
        return without.offset(skipped).limit(PAGE_ROWS)
    counts = IdCounts(rows.select("id"), low, high)
    first = counts.around(skipped)
    if first is None:
        return without.offset(skipped - counts.total()).limit(PAGE_ROWS)
    last = counts.around(skipped + PAGE_ROWS - 1)
    near = rows.filter(F.col("id").between(last[0] if last else low, first[1]))
    if last is None:
        near = near.unionAll(without)
    return near.orderBy(F.desc_nulls_last("id")).offset(skipped - first[2]).limit(PAGE_ROWS)


def browse(
    shop: Shop,
    name: str,
    store: Store,
    search_term: str | None = None,
    filters: Mapping[str, object] | None = None,
    now: datetime | None = None,
    page: int = 0,
) -> DataFrame:
    """One page of a table, newest id first, with labels in place of keys and codes.

    Filtering, searching and finding the page come first; labels are then looked up for the rows of
    that page alone, and the page is put in order at the end.
    """
    listing = LISTINGS[name]
    rows = shop[name].select(
        *dict.fromkeys(
            ["id", *listing.shown, *[p[0] for p in listing.searched], *[p[0] for p in listing.filters.values()]]
        )
    )
    rows = apply_filters(shop, name, rows, filters or {}, now)
    rows = search(shop, name, rows, search_term)
    shown = store.keep(_page(shop, name, rows.select("id", *listing.shown), page), f"page-{name}")

    result = shown
    columns: list[Column] = [F.col("id")]
    for column_name in listing.shown:
        column = table(name)[column_name]
        if column.refers_to:
            ids = shown.select(F.col(column_name).alias("_wanted")).distinct()
            labels = label_frame(shop, column.refers_to, ids).select(
                F.col("id").alias(f"_id_{column_name}"), F.col("label").alias(f"_label_{column_name}")
            )
            result = result.join(
                F.broadcast(labels), F.col(column_name) == F.col(f"_id_{column_name}"), "left"
            )
            columns.append(F.col(f"_label_{column_name}").alias(column_name.removesuffix("_id")))
        elif column.choices:
            columns.append(code_label(F.col(column_name), column.choices).alias(column_name))
        else:
            columns.append(F.col(column_name))
    return result.select(*columns).orderBy(F.desc("id"))
