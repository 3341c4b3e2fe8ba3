"""Export files read back byte by byte."""

from __future__ import annotations

import csv
import io
from datetime import datetime
from pathlib import Path

from coursemill.plans.exports import EXPORTS, all_exports
from coursemill.sinks import write_csv, write_exports
from coursemill.sources import read_table


def local_files(path: str) -> list[Path]:
    return sorted(Path(path.removeprefix("file:")).glob("part-*"))


def test_bytes_are_those_of_a_csv_writer(spark, store):
    texts = ["plain", "a,b", 'say "hi"', "two\nlines", "cr\rhere", " padded ", "", None, "你好", "#x", "'q'", '"', "\\", 'a\\"b']
    rows = [(i, t, i % 2 == 0, datetime(2024, 1, 2, 3, 4, 5, 60 * (i % 2))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, body string, flag boolean, at timestamp_ntz").coalesce(1)
    path = store.fresh_path("csv")
    write_csv(df, path, single_file=True)
    (file,) = local_files(path)

    want = io.StringIO(newline="")
    writer = csv.writer(want)
    writer.writerow(["id", "body", "flag", "at"])
    for i, t, flag, at in rows:
        writer.writerow([i, t, flag, f"{at}+00:00"])
    assert file.read_bytes().decode("utf-8") == "﻿" + want.getvalue()


def test_all_exports_are_written_whole_in_parallel(spark, store, shop):
    folder = store.fresh_path("exports")
    exports = all_exports(shop)
    write_exports(exports, folder)
    for name in EXPORTS:
        rows, headers = 0, set()
        for file in local_files(f"{folder}/{name}.csv"):
            text = file.read_bytes().decode("utf-8")
            assert text.startswith("﻿") and text.count("﻿") == 1
            lines = list(csv.reader(io.StringIO(text[1:], newline="")))
            headers.add(tuple(lines[0]))
            rows += len(lines) - 1
        assert headers == {tuple(exports[name].columns)}
        assert rows == exports[name].count()


def test_lessons_export_keeps_course_order(spark, store, shop):
    path = store.fresh_path("csv")
    write_csv(EXPORTS["course_lessons"](shop), path, single_file=True)
    lines = list(csv.DictReader(io.StringIO(local_files(path)[0].read_bytes().decode("utf-8-sig"), newline="")))
    keys = [(int(r["course_id"]), r["chapter_title"], int(r["sort_order"])) for r in lines]
    assert keys == sorted(keys)


def test_tables_can_be_read_from_csv(spark, store, shop):
    path = store.fresh_path("csv")
    shop["coupons"].write.option("header", True).option("escape", '"').csv(path)
    again = read_table(spark, "coupons", path, "csv")
    assert sorted(map(str, again.collect())) == sorted(
        map(str, shop["coupons"].select(*again.columns).collect())
    )
