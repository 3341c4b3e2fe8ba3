"""The demo shop's figures, worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest

from coursemill.operators.labels import row_labels
from coursemill.operators.quality import validate
from coursemill.plans import metrics
from coursemill.sources.seed import seed_shop

NOW = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def demo(spark, store):
    return seed_shop(spark, store, NOW)


def test_row_counts(demo):
    want = dict(
        users=6, profiles=5, categories=3, courses=4, chapters=8, lessons=16, coupons=2, user_coupons=3, promotions=1,
        promotion_courses=4, carts=2, cart_items=2, orders=5, order_items=5, payments=5, coupon_usages=3, enrollments=5,
        learning_records=10, favorites=3, reviews=3, notifications=3, questions=1, answers=1, audits=4, refunds=0,
    )
    assert {name: demo[name].count() for name in want} == want


def test_prices_and_payments(demo):
    orders = demo["orders"].orderBy("id").collect()
    assert [o.final_price for o in orders] == [1700, 2000, 1440, 1500, 1100]
    assert [o.discount_amount for o in orders] == [100, 0, 360, 0, 100]
    numbers = [p.transaction_no for p in demo["payments"].orderBy("id").collect()]
    assert numbers == [f"MOCK-{i:05d}" for i in range(1, 6)]


def test_course_and_teacher_figures(demo):
    cards = {r.course_id: r for r in metrics.course_scorecard(demo).collect()}
    assert [cards[i].purchase_count for i in (1, 2, 3, 4)] == [2, 1, 1, 1]
    assert [cards[i].total_watch_minutes for i in (1, 2, 3, 4)] == [70, 35, 35, 35]
    assert [cards[i].average_rating for i in (1, 2, 3, 4)] == [4.5, None, None, 5.0]
    series = {r.course_id: r.rating for r in metrics.teacher_course_series(demo).collect()}
    assert series == {1: 4.5, 2: 0.0, 3: 0.0, 4: 5.0}
    totals = {r.teacher_id: r.total_revenue for r in metrics.teacher_totals(demo).collect()}
    assert totals == {2: 4640, 3: 3100}


def test_student_figures(demo):
    kpis = {r.user_id: (r.total_minutes, r.purchased_count) for r in metrics.student_kpis(demo).collect()}
    assert [kpis[u] for u in (4, 5, 6)] == [(70, 2), (70, 2), (35, 1)]
    assert 1 not in kpis  # the administrator has no profile
    uses = {r.code: r.used_count for r in metrics.coupon_usage_counts(demo).collect()}
    assert uses == {"NEW100": 2, "SALE20": 1}


def test_the_demo_shop_breaks_no_rule(demo):
    assert validate(demo).collect() == []


def test_labels(demo):
    labels = {(r.table_name, r.id): r.label for r in row_labels(demo).collect()}
    assert labels["orders", 1] == "student_amy - Python Django 線上課程平台實作 - NT$ 1700"
    assert labels["profiles", 1] == "teacher_python - 老師"
    assert labels["payments", 1] == "訂單 1 - NT$ 1700 - 付款成功"
    assert labels["carts", 1] == "student_amy 的購物車"
    assert len(labels) == sum(demo[t].count() for t in demo if t not in ("users", "promotion_courses"))
