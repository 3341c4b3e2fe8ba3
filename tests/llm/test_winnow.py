from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursemill.llm.winnow import contamination, gram_and_window, selected

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, length=10):
    out = []
    for i, text in docs:
        w, gone, met = words(text), set(), set()
        for item, item_text in items:
            v = words(item_text)
            n = min(length, len(v))
            own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in own:
                    gone.update(range(k, k + n))
                    met.add("" if item is None else str(item))
        out.append((i, len(w), len(gone), sorted(met)))
    return sorted(out, key=str)


def some_tables():
    rng = np.random.default_rng(3)
    vocabulary = np.array(["a", "the", "Über", "x1", "1", "word", "WORD", "zz", "été"])
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((25, 12, 10, 9, 3, 1, 0, 40))]
    items += [(0, items[0][1]), (None, "nobody has this one item text at all in any document here"), (9, None), (9, "q q")]
    docs = []
    for k in range(40):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30)))]
        v = items[k % 8][1].split()
        a = int(rng.integers(0, len(v) + 1))
        parts.append(", ".join(v[a : a + int(rng.integers(5, 30))]).upper())
        docs.append((k % 30, "\n".join(parts)))
    return docs + [(None, None), (50, ""), (51, "..."), (52, "long " * 50_000 + items[0][1]), (53, items[2][1])], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, store, block_bytes):
    docs, items = some_tables()
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, spans int").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    found = contamination(left, right, store, block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str)
    assert got == brute(docs, items)
    for r in found.collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_empty_tables_and_carried_rows(spark, store):
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id bigint, text string, n_hit int")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in contamination(docs, none, store).collect()] == [(1, 2, 0)]
    assert contamination(docs.limit(0), none, store).count() == 0
    kept = contamination(docs, none, store, carry=True).select("row.*")
    assert kept.schema == docs.schema and kept.collect() == docs.collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_every_window_has_its_smallest_hash_selected(values, length):
    _, w = gram_and_window(length)
    hashes = np.array(values, np.uint64)
    chosen = set(selected(hashes, w).tolist())
    for k in range(len(values) - w + 1):
        window = values[k : k + w]
        assert k + window.index(min(window)) in chosen
