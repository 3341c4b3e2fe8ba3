"""Checkout against a model that serves requests one after the other."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coursemill import Shop
from coursemill.plans import checkout
from coursemill.schema import TABLES
from tests.test_functions import python_discount

DAY = datetime(2024, 1, 1)


def make_worlds(n, seed=5):
    """Many small independent shops side by side, told apart by their id ranges."""
    rng = random.Random(seed)
    data = {k: [] for k in ("courses", "coupons", "profiles", "enrollments", "coupon_usages", "requests")}
    for w in range(n):
        base = w * 100
        for c in range(3):
            data["courses"].append((base + c, f"c{base + c}", rng.choice([0, 80, 600, 1000])))
        for k in range(3):
            data["coupons"].append(
                (
                    base + k,
                    f"CODE{base + k}",
                    rng.choice(["amount", "percent"]),
                    rng.choice([10, 50, 2000]),
                    rng.choice([0, 0, 500]),
                    DAY,
                    DAY + timedelta(days=rng.choice([3, 30])),
                    rng.choice([0, 1, 1, 2, 3]),
                    rng.random() < 0.9,
                )
            )
        for u in range(4):
            if rng.random() < 0.9:
                data["profiles"].append((base + u, base + u, "student"))
        for u in range(2):
            if rng.random() < 0.3:
                data["enrollments"].append((base + u, base + u, base + rng.randrange(3), DAY))
        for i in range(rng.randrange(3)):
            data["coupon_usages"].append((base + i, base, base + rng.randrange(3), base + 50 + i, 1, DAY))
        for i in range(rng.randrange(4, 16)):
            code = rng.choice([None, "", "  ", "nothing"] + [f" code{base + rng.randrange(3)}\t"] * 8)
            data["requests"].append(
                (base + i, base + rng.randrange(4), base + rng.randrange(4), code, DAY + timedelta(days=rng.randrange(6)))
            )
    return data


def serve_in_order(data):
    price = {c[0]: c[2] for c in data["courses"]}
    coupons = {c[1].lower(): c for c in data["coupons"]}
    profiles = {p[1] for p in data["profiles"]}
    owned = {(e[1], e[2]) for e in data["enrollments"]}
    uses = {}
    for u in data["coupon_usages"]:
        uses[u[2]] = uses.get(u[2], 0) + 1
    done = []
    for i, user, course, code, at in sorted(data["requests"], key=lambda r: (r[4], r[0])):
        if course not in price or user not in profiles or (user, course) in owned:
            continue
        code = (code or "").strip().lower()
        coupon, discount = None, 0
        if code:
            coupon = coupons.get(code)
            if coupon is None:
                continue
            k, _, kind, value, least, start, end, limit, active = coupon
            if not active or start > at or end < at or (limit > 0 and uses.get(k, 0) >= limit):
                continue
            discount = python_discount(price[course], least, kind, value)
            if discount <= 0:
                continue
            uses[k] = uses.get(k, 0) + 1
        owned.add((user, course))
        done.append((i, user, course, coupon and coupon[0], price[course], discount, price[course] - discount))
    return done


def shop_of(spark, data):
    def table(name, columns, rows):
        df = spark.createDataFrame(rows, columns) if rows else spark.createDataFrame([], columns)
        return df.select(*[F.col(c).cast(TABLES[name][c].spark_type) for c in df.columns])

    tables = {
        "courses": table("courses", "id bigint, title string, price int", data["courses"]),
        "coupons": table(
            "coupons",
            "id bigint, code string, discount_type string, discount_value bigint, min_spend bigint, "
            "start_date timestamp_ntz, end_date timestamp_ntz, usage_limit bigint, is_active boolean",
            data["coupons"],
        ),
        "profiles": table("profiles", "id bigint, user_id bigint, role string", data["profiles"]),
        "enrollments": table(
            "enrollments", "id bigint, student_id bigint, course_id bigint, purchased_at timestamp_ntz", data["enrollments"]
        ),
        "coupon_usages": table(
            "coupon_usages",
            "id bigint, user_id bigint, coupon_id bigint, order_id bigint, discount_amount bigint, used_at timestamp_ntz",
            data["coupon_usages"],
        ),
    }
    for empty in ("orders", "order_items", "payments", "notifications"):
        tables[empty] = spark.createDataFrame([], TABLES[empty].struct)
    return Shop.of(**tables)


def requests_of(spark, data):
    return spark.createDataFrame(
        data["requests"], "id bigint, user_id bigint, course_id bigint, coupon_code string, requested_at timestamp_ntz"
    )


def test_acceptance_equals_serving_in_order(spark, store):
    data = make_worlds(400)
    want = serve_in_order(data)
    done = checkout.checkout(shop_of(spark, data), requests_of(spark, data), store)
    got = done.numbered.orderBy("number").collect()
    assert [(r.id, r.user_id, r.course_id, r.coupon_id, r.price, r.discount, r.final) for r in got] == want
    assert [r.number for r in got] == list(range(1, len(want) + 1))
    limited = {c[0]: c[7] for c in data["coupons"] if c[7]}
    assert any(r.coupon_id in limited for r in got)


def test_every_table_gets_its_rows_and_a_second_run_adds_nothing(spark, store):
    data = make_worlds(60, seed=8)
    shop, requests = shop_of(spark, data), requests_of(spark, data)
    rows = {k: store.keep(df, k) for k, df in checkout.checkout(shop, requests, store).new_rows().items()}
    orders = {r.id: r for r in rows["orders"].collect()}
    assert len(orders) == rows["order_items"].count() == rows["payments"].count() == rows["notifications"].count()
    for p in rows["payments"].collect():
        assert p.amount == orders[p.order_id].final_price and p.transaction_no == f"MOCK-{p.order_id:05d}"
    for i in rows["order_items"].collect():
        assert i.price == orders[i.order_id].original_price
    with_coupon = {i for i, o in orders.items() if o.coupon_id is not None}
    assert {u.order_id for u in rows["coupon_usages"].collect()} == with_coupon
    for o in orders.values():
        assert o.final_price == o.original_price - o.discount_amount and o.status == "paid"

    after = {k: shop[k].unionByName(df, allowMissingColumns=True) for k, df in rows.items()}
    again = checkout.checkout(shop.replace(**after), requests, store)
    owned = {(e.student_id, e.course_id) for e in after["enrollments"].collect()}
    assert not [r for r in again.numbered.collect() if (r.user_id, r.course_id) in owned]


def test_numbers_in_transaction_names_are_not_cut(spark):
    wide = spark.range(1).select(F.format_string("MOCK-%05d", F.lit(1234567))).first()[0]
    assert wide == "MOCK-1234567"


def test_codes_that_differ_only_in_case_do_not_double_a_request(spark, store):
    data = make_worlds(1)
    data["courses"], data["profiles"] = [(1, "c1", 1000)], [(1, 1, "student")]
    data["enrollments"], data["coupon_usages"] = [], []
    end = DAY + timedelta(days=9)
    data["coupons"] = [
        (1, "SAVE", "amount", 10, 0, DAY, end, 0, True),
        (2, "save", "amount", 99, 0, DAY, end, 0, True),
    ]
    data["requests"] = [(1, 1, 1, "Save", DAY)]
    priced = checkout.price_checkout(shop_of(spark, data), requests_of(spark, data)).collect()
    assert [(r.coupon_id, r.discount) for r in priced] == [(1, 10)]


def test_a_chain_of_displaced_buyers_leaves_the_iteration_step_by_step(spark, store, monkeypatch):
    """Each buyer loses a coupon's last use to the one before and takes the next coupon's: one round each.

    What lies before the earliest cutoff that moved is final, so the open requests get fewer in every round.
    """
    n = 9
    data = {k: [] for k in ("courses", "coupons", "profiles", "enrollments", "coupon_usages", "requests")}
    data["courses"] = [(1, "c", 100)]
    for i in range(n):
        data["coupons"].append((i, f"K{i}", "amount", 10, 0, DAY, DAY + timedelta(days=99), 1, True))
        data["profiles"].append((i, i, "student"))
        data["requests"].append((10 * i, i, 1, f"k{i}", DAY + timedelta(hours=2 * i)))
        if i:
            data["requests"].append((10 * i + 1, i, 1, f"k{i - 1}", DAY + timedelta(hours=2 * i - 1)))
    sizes, keep = [], store.keep

    def watched(df, label):
        kept = keep(df, label)
        if label == "checkout-open":
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(store, "keep", watched)
    done = checkout.checkout(shop_of(spark, data), requests_of(spark, data), store)
    got = [(r.id, r.user_id, r.course_id, r.coupon_id, r.price, r.discount, r.final) for r in done.numbered.orderBy("number").collect()]
    assert got == serve_in_order(data) and len(got) == n
    assert len(sizes) >= 5 and sizes[0] >= sizes[1] and all(a > b for a, b in zip(sizes[1:], sizes[2:]))


def test_tables_that_grow_are_not_broadcast(spark, store):
    """Courses and profiles, though far below the threshold here: Spark's guess of their size may be ten times too low."""
    data = make_worlds(3)
    shop, requests = shop_of(spark, data), requests_of(spark, data)
    done = checkout.checkout(shop, requests, store)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    priced = plan(checkout.price_checkout(shop, checkout.eligible(shop, requests)))
    assert priced.count("rightHint=(strategy=merge)") == 2
    done._next_id = lambda name: F.col("number")  # these shops have no notifications
    assert plan(done.notifications()).count("rightHint=(strategy=merge)") == 1
