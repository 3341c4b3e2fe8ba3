"""A batch of checkout requests: price, gate, accept, and the rows each purchase writes.

A request is ``(id, user_id, course_id, coupon_code, requested_at)``; requests count in
(requested_at, id) order, as if the shop had served them one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import coupon_discount, coupon_usable, strip
from ..operators.lookup import growing, only_existing, only_missing, rename
from ..operators.merging import absent, with_new_ids
from ..operators.numbering import number_rows, one_per_key
from ..operators.unions import union_all
from ..schema import PURCHASE_NOTICE_TITLE
from ..shop import Shop
from ..store import Store

OK = "ok"
NOT_FOUND = "coupon_not_found"
NOT_USABLE = "coupon_not_usable"
NO_DISCOUNT = "coupon_no_discount"

PRICED = ["id", "user_id", "course_id", "coupon_id", "requested_at", "price", "discount", "final"]


def _coupon_book(shop: Shop) -> DataFrame:
    """Coupons with their uses so far, one per code whatever its case."""
    coupons = one_per_key(
        shop["coupons"]
        .select(
            F.lower("code").alias("_code"),
            F.col("id").alias("_coupon"),
            "discount_type",
            "discount_value",
            "min_spend",
            "start_date",
            "end_date",
            "usage_limit",
            "is_active",
        ),
        ["_code"],
        ["_coupon"],
    )
    uses = shop["coupon_usages"].groupBy(F.col("coupon_id").alias("_coupon")).agg(F.count(F.lit(1)).alias("_uses"))
    return coupons.join(uses, "_coupon", "left").withColumn("_uses", F.coalesce("_uses", F.lit(0)))


def price_checkout(shop: Shop, requests: DataFrame) -> DataFrame:
    """Price, discount and outcome of each request for an existing course.

    A coupon that is unknown, not usable or gives nothing refuses the whole purchase.
    """
    prices = growing(rename(shop["courses"], course_id="id", price="price"))
    # nullif leaves requests without a code with a null key: they match no coupon.
    asked = requests.withColumn("_code", F.nullif(F.lower(strip(F.col("coupon_code"))), F.lit("")))
    known = F.col("_coupon").isNotNull()
    usable = coupon_usable(
        F.col("requested_at"),
        F.col("is_active"),
        F.col("start_date"),
        F.col("end_date"),
        F.col("usage_limit"),
        F.col("_uses"),
    )
    granted = coupon_discount(
        F.col("price"), F.col("min_spend"), F.col("discount_type"), F.col("discount_value")
    )
    outcome = (
        F.when(F.col("_code").isNull(), OK)
        .when(~known, NOT_FOUND)
        .when(~usable, NOT_USABLE)
        .when(granted <= 0, NO_DISCOUNT)
        .otherwise(OK)
    )
    applied = (F.col("outcome") == OK) & known
    price = F.col("price").cast("bigint")
    discount = F.when(applied, granted).otherwise(F.lit(0).cast("bigint"))
    return (
        asked.join(prices, "course_id")
        .join(_coupon_book(shop), "_code", "left")
        .withColumn("outcome", outcome)
        .select(
            "id",
            "user_id",
            "course_id",
            F.when(applied, F.col("_coupon")).alias("coupon_id"),
            "requested_at",
            price.alias("price"),
            discount.alias("discount"),
            (price - discount).alias("final"),
            "outcome",
        )
    )


def eligible(shop: Shop, requests: DataFrame) -> DataFrame:
    """Requests of users with a profile for courses they do not have yet."""
    known = only_existing(requests, growing(shop["profiles"]), {"user_id": "user_id"})
    return only_missing(known, shop["enrollments"], {"user_id": "student_id", "course_id": "course_id"})


_TIME_ORDER = ["requested_at", "id"]


def _first_per_pair(rows: DataFrame) -> DataFrame:
    return one_per_key(rows, ["user_id", "course_id"], _TIME_ORDER)


def _limited(shop: Shop) -> DataFrame:
    """Coupons with a usage limit and the number of uses that are left."""
    uses = shop["coupon_usages"].groupBy("coupon_id").agg(F.count(F.lit(1)).alias("_uses"))
    return (
        shop["coupons"]
        .filter("usage_limit > 0")
        .select(F.col("id").alias("coupon_id"), "usage_limit")
        .join(uses, "coupon_id", "left")
        .select("coupon_id", (F.col("usage_limit") - F.coalesce("_uses", F.lit(0))).alias("left"))
    )


def _before_cutoff(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    late = F.struct("requested_at", "id") > F.struct("_cut_at", "_cut_id")
    return (
        rows.join(cutoffs, "coupon_id", "left")
        .filter(F.col("_cut_id").isNull() | ~late)
        .select(*rows.columns)
    )


def _last_allowed(winners: DataFrame, store: Store) -> DataFrame:
    """Per coupon, the winner that takes its last use; nothing for a coupon with uses to spare."""
    rows = winners.select("coupon_id", "left", *_TIME_ORDER)
    ranked = number_rows(rows, ["coupon_id"], [F.col(c) for c in _TIME_ORDER], store)
    return ranked.filter(F.col("position") == F.col("left")).select(
        "coupon_id", F.col("requested_at").alias("_cut_at"), F.col("id").alias("_cut_id")
    )


def _frontier(before: DataFrame, after: DataFrame) -> Row:
    """The earliest time (as text, for it goes back as a literal) and request id at which a coupon's cutoff came or
    went; nulls if all are at rest."""
    sides = [
        cutoffs.select("coupon_id", F.struct("_cut_at", "_cut_id").alias(side))
        for side, cutoffs in (("_old", before), ("_new", after))
    ]
    moved = sides[0].join(sides[1], "coupon_id", "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    first = moved.agg(F.min(F.least("_old", "_new")).alias("first"))
    return first.select(F.col("first._cut_at").cast("string").alias("at"), F.col("first._cut_id").alias("id")).first()


def _contested(left: DataFrame, rows: DataFrame) -> DataFrame:
    """Coupons that are asked for more often than they have uses left."""
    asked = rows.filter(F.col("coupon_id").isNotNull()).groupBy("coupon_id").agg(F.count(F.lit(1)).alias("_asked"))
    return left.join(asked, "coupon_id").filter(F.col("_asked") > F.col("left")).select("coupon_id", "left")


def accept(shop: Shop, priced: DataFrame, store: Store) -> DataFrame:
    """The requests that become purchases: first good request per (user, course), coupon limits kept.

    Whether a request succeeds depends on earlier successes: one for the same pair, or enough
    of the same limited coupon. The second only matters for coupons asked for more often than
    they have uses left, and only for pairs with such a request; everything else is settled by
    one aggregation. For the rest, repeat: pick winners among the requests not cut off; a
    coupon's last allowed winner is its new cutoff. What lies before the earliest cutoff that moved
    depends on nothing that still may change, so it is final: its winners are settled, and they, all
    other requests before that time, later ones for the same pairs and those for used-up coupons
    leave the iteration. Each round settles at least the earliest open request, so the loop ends, with
    the result of serving in order.
    The state between rounds is one row per contested coupon and the open requests, with the uses left.
    """
    good = store.keep(priced.filter(F.col("outcome") == OK).select(*PRICED), "checkout-good")
    left = store.keep(_contested(_limited(shop), good), "checkout-contested")
    if left.isEmpty():
        return _first_per_pair(good)
    pairs = good.join(left, "coupon_id", "left_semi").select("user_id", "course_id").distinct()
    settled = [_first_per_pair(good.join(pairs, ["user_id", "course_id"], "left_anti").select(*PRICED))]
    rows = good.join(pairs, ["user_id", "course_id"], "left_semi").join(left, "coupon_id", "left").select(*PRICED, "left")
    rows = store.keep(rows, "checkout-open")

    cut_type = good.schema["requested_at"].dataType
    cutoffs = good.sparkSession.createDataFrame([], f"coupon_id bigint, _cut_at {cut_type.simpleString()}, _cut_id bigint")
    while True:
        winners = store.keep(_first_per_pair(_before_cutoff(rows, cutoffs)), "checkout-winners")
        moved = _last_allowed(winners.filter("left is not null"), store)
        first = _frontier(cutoffs, moved)
        if first["id"] is None:
            return union_all([*settled, winners.select(*PRICED)])
        frontier = F.struct(F.lit(first["at"]).cast(cut_type).alias("requested_at"), F.lit(first["id"]).cast("bigint").alias("id"))
        final = winners.filter(F.struct(*_TIME_ORDER) < frontier)
        settled.append(final.select(*PRICED))
        # A coupon whose last use is final has none left, so no cutoff before the frontier is needed again.
        cutoffs = moved.filter(F.struct("_cut_at", "_cut_id") >= frontier)
        uses = final.groupBy("coupon_id").agg(F.count(F.lit(1)).alias("_uses"))
        later = rows.filter(F.struct(*_TIME_ORDER) >= frontier).join(final, ["user_id", "course_id"], "left_anti")
        later = later.join(uses, "coupon_id", "left").withColumn("left", F.col("left") - F.coalesce("_uses", F.lit(0)))
        rows = store.keep(later.filter("left is null or left > 0").select(*PRICED, "left"), "checkout-open")


PURCHASED = ["user_id", "course_id", "requested_at", "id"]


class Purchases:
    """The rows that a batch of accepted requests adds to each table.

    Each purchase takes the next number in time order; a new row's id is the table's highest
    id so far plus that number.
    """

    def __init__(self, shop: Shop, accepted: DataFrame, store: Store, enrolled: DataFrame | None = None):
        """``enrolled`` names the requests that enrol, where these are others than the accepted ones."""
        self.shop, self.store, self.enrolled = shop, store, enrolled
        order = [F.col(c) for c in _TIME_ORDER]
        self.numbered = store.keep(number_rows(accepted, [], order, store, "number"), "purchases")

    def _next_id(self, name: str) -> F.Column:
        highest = self.shop[name].agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        return highest + F.col("number")

    def orders(self) -> DataFrame:
        return self.numbered.select(
            self._next_id("orders").alias("id"),
            "user_id",
            "course_id",
            "coupon_id",
            F.col("price").alias("original_price"),
            F.col("discount").alias("discount_amount"),
            F.col("final").alias("final_price"),
            F.lit("paid").alias("status"),
            F.col("requested_at").alias("created_at"),
        )

    def order_items(self) -> DataFrame:
        """Items carry the price before the discount."""
        return self.numbered.select(
            self._next_id("order_items").alias("id"),
            self._next_id("orders").alias("order_id"),
            "course_id",
            "price",
        )

    def payments(self) -> DataFrame:
        order_id = self._next_id("orders")
        return self.numbered.select(
            self._next_id("payments").alias("id"),
            order_id.alias("order_id"),
            F.lit("mock").alias("method"),
            F.col("final").alias("amount"),
            F.lit("paid").alias("status"),
            F.format_string("MOCK-%05d", order_id).alias("transaction_no"),
            F.col("requested_at").alias("paid_at"),
            F.col("requested_at").alias("created_at"),
        )

    def new_enrollments(self) -> DataFrame:
        """Only pairs that are not enrolled yet."""
        key, known = ["student_id", "course_id"], self.shop["enrollments"]
        requests = self.numbered if self.enrolled is None else self.enrolled
        rows = requests.select(
            "id", F.col("user_id").alias("student_id"), "course_id", F.col("requested_at").alias("purchased_at")
        )
        return with_new_ids(known, absent(known, rows, key, ["purchased_at", "id"]), ["purchased_at", "id"], self.store)

    def enrollments(self) -> DataFrame:
        return self.shop["enrollments"].unionByName(self.new_enrollments())

    def coupon_usages(self) -> DataFrame:
        return self.numbered.filter(F.col("coupon_id").isNotNull()).select(
            self._next_id("coupon_usages").alias("id"),
            "user_id",
            "coupon_id",
            self._next_id("orders").alias("order_id"),
            F.col("discount").alias("discount_amount"),
            F.col("requested_at").alias("used_at"),
        )

    def notifications(self) -> DataFrame:
        titles = growing(rename(self.shop["courses"], course_id="id", title="title"))
        # The wording of the purchase notice.
        content = F.concat(
            F.lit("你已成功購買「"), F.col("title"), F.lit("」，實付金額 NT$ "), F.col("final").cast("string"), F.lit("。")
        )
        return self.numbered.join(titles, "course_id").select(
            self._next_id("notifications").alias("id"),
            "user_id",
            F.lit(PURCHASE_NOTICE_TITLE).alias("title"),
            content.alias("content"),
            F.lit(False).alias("is_read"),
            F.col("requested_at").alias("created_at"),
        )

    def new_rows(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders(),
            "order_items": self.order_items(),
            "payments": self.payments(),
            "enrollments": self.new_enrollments(),
            "coupon_usages": self.coupon_usages(),
            "notifications": self.notifications(),
        }


def checkout(shop: Shop, requests: DataFrame, store: Store) -> Purchases:
    """The whole job: gate, price, accept, and the rows to append."""
    priced = price_checkout(shop, eligible(shop, requests))
    return Purchases(shop, accept(shop, priced, store), store)


def planned_purchases(shop: Shop, plan: DataFrame, store: Store) -> Purchases:
    """Purchases from a plan ``(id, user_id, course_id, coupon_id, requested_at)``.

    Coupons are applied without asking whether they are usable. A pair that already has an order gets no
    other order, item, payment or usage, but is enrolled if it is not yet: the order may have been cancelled.
    """
    prices = growing(rename(shop["courses"], course_id="id", price="price"))
    coupons = rename(
        shop["coupons"],
        coupon_id="id",
        discount_type="discount_type",
        discount_value="discount_value",
        min_spend="min_spend",
    )
    granted = coupon_discount(
        F.col("price"), F.col("min_spend"), F.col("discount_type"), F.col("discount_value")
    )
    discount = F.when(F.col("discount_type").isNotNull(), granted).otherwise(F.lit(0).cast("bigint"))
    price = F.col("price").cast("bigint")
    priced = (
        plan.join(prices, "course_id")
        .join(coupons, "coupon_id", "left")
        .select(
            "id",
            "user_id",
            "course_id",
            "coupon_id",
            "requested_at",
            price.alias("price"),
            discount.alias("discount"),
            (price - discount).alias("final"),
        )
    )
    fresh = absent(shop["orders"], priced, ["user_id", "course_id"], _TIME_ORDER)
    return Purchases(shop, fresh, store, enrolled=priced.select(*PURCHASED))


def coupon_validity(shop: Shop, at: F.Column) -> DataFrame:
    """Whether each coupon may be used at time ``at``."""
    uses = shop["coupon_usages"].groupBy("coupon_id").agg(F.count(F.lit(1)).alias("used_count"))
    coupons = shop["coupons"].withColumnRenamed("id", "coupon_id").join(uses, "coupon_id", "left")
    used = F.coalesce(F.col("used_count"), F.lit(0))
    return coupons.select(
        "coupon_id",
        "code",
        used.alias("used_count"),
        coupon_usable(
            at, F.col("is_active"), F.col("start_date"), F.col("end_date"), F.col("usage_limit"), used
        ).alias("usable"),
    )
