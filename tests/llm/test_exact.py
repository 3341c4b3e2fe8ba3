from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from coursemill.llm.exact import duplicate_groups, without_duplicates


def rows(spark, data, schema="doc_id bigint, text string, keep_id string, _hash int"):
    return spark.createDataFrame([(*r, "x", 1) for r in data], schema)


CASES = [(3, "a  b"), (1, "a\t\r\nb"), (2, None), (5, ""), (4, "a b "), (None, "a b"), (6, "a b"), (6, "a b"), (7, "x" * 300_000)]


def expected(data):
    import re

    groups: dict[str, list] = {}
    for i, text in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups(spark):
    assert sorted(map(tuple, duplicate_groups(rows(spark, CASES)).collect()), key=str) == expected(CASES)


def test_texts_with_one_hash_are_told_apart_by_their_bytes(spark):
    found = duplicate_groups(rows(spark, CASES), hashed=lambda text: F.lit(b"same"))
    assert sorted(map(tuple, found.collect()), key=str) == expected(CASES)


def test_rows_that_stay(spark):
    left = without_duplicates(rows(spark, CASES))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4, 7]
    assert left.columns == ["doc_id", "text", "keep_id", "_hash"]


def test_empty_table(spark):
    assert duplicate_groups(rows(spark, [])).count() == 0
    assert without_duplicates(rows(spark, [])).count() == 0
