"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. The shop tables are derived and written
once beforehand (``setup``); each query is then built, planned and executed in full, twice,
and the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.derive import derived, shop_from  # noqa: E402
from checks.queries import all_queries  # noqa: E402
from coursemill.session import local_session  # noqa: E402

HEADLINE = (
    "course_scorecard",
    "teacher_totals",
    "student_minutes_by_title",
    "recent_learning",
    "my_courses",
    "student_kpis",
    "catalog_search",
    "export_order_items",
    "export_learning_records",
    "export_enrollments",
    "price_checkout",
    "checkout_accepted",
    "checkout_orders",
    "review_upsert",
    "cascade_delete_counts",
    "browse_order_items",
    "student_chart_json",
    "teacher_chart_json",
    "dq_foreign_keys",
    "dq_required",
    "dq_unique_pairs",
    "stream_watch_minutes",
)
FEEDS = ("lms_checkout_requests", "lms_review_submissions", "lms_watch_requests", "lms_delete_requests")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = sys.argv[1:] or HEADLINE
    queries = all_queries()

    start = time.time()
    shop = shop_from(spark, folder)
    for name in shop:
        shop[name]
    for name in (*FEEDS, "lms_faulty_orders", "lms_faulty_users", "lms_faulty_categories", "lms_faulty_payments", "lms_faulty_notifications"):
        derived(spark, folder, name)
    setup = time.time() - start

    seconds = {}
    for name in chosen:
        runs = []
        for _ in range(2):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "setup": round(setup, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
