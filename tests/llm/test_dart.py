from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coursemill.llm import dart_minhash as dart
from coursemill.llm.common import read_table, text_bytes, words_of
from coursemill.llm.components import components

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def weights(text):
    w = WORD.findall((text or "").encode().lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def brute(rows):
    """Class of each row, by comparing every pair that shares a shingle."""
    sets = [weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders: dict = {}
    for k, s in enumerate(sets):
        for shingle in s:
            holders.setdefault(shingle, []).append(k)
    for k, s in enumerate(sets):
        for other in {o for shingle in s for o in holders[shingle] if o > k}:
            both = sum((s & sets[other]).values())
            if both / sum((s | sets[other]).values()) >= 0.8:
                a, b = sorted((find(k), find(other)))
                root[b] = a
    ids: dict[int, list] = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        own = ids[find(k)]
        known = [x for x in own if x is not None]
        out.append((i, min(known) if known else None, len(own)))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", "class_id", "class_size").collect()), key=str)


def some_rows():
    choose = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for group, size in enumerate((40, 3, 2, 1, 1, 12)):
        base = choose.choices(vocabulary, k=choose.randint(150, 400))
        for _ in range(size):
            text = list(base)
            for _ in range(choose.randint(0, 3)):
                text[choose.randrange(len(text))] = choose.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base[: len(base) * 3 // 4])))
    rows += [(900, "A, b. c d e f"), (901, "a b c d e f"), (902, "one two"), (903, "two one"), (904, "one TWO")]
    rows += [(905, "again and " * 40), (906, "again and " * 80), (907, "big " * 30_000)]
    return rows + [(950, None), (951, ""), (952, "..."), (None, "one two"), (3, rows[3][1]), (3, rows[3][1]), (960, rows[0][1])]


@pytest.mark.parametrize("small_bucket", [8, 1])
def test_against_brute_force(spark, store, monkeypatch, small_bucket):
    monkeypatch.setattr(dart, "SMALL_BUCKET", small_bucket)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id bigint, text string, a binary, root int").repartition(3)
    assert found(dart.near_duplicates(docs, store)) == brute(rows)


def test_documents(spark, store):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert found(dart.near_duplicates(docs, store)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def form_rows(pairs, others):
    """One form filled in differently, pairwise below 0.8, but for pairs that share a part of what is filled in."""
    choose = random.Random(11)
    form = [f"f{k}" for k in range(300)]
    fill = lambda n: [f"x{choose.randrange(1 << 40)}" for _ in range(n)]
    rows = []
    for _ in range(pairs):
        common = fill(6)
        rows += [(len(rows) + k, " ".join(form + common + fill(34))) for k in range(2)]
    rows += [(len(rows) + k, " ".join(form + fill(40))) for k in range(others)]
    choose.shuffle(rows)
    return rows


def test_single_links_in_large_buckets(spark, store):
    rows = form_rows(80, 140)
    expected = brute(rows)
    assert [size for _, _, size in expected].count(2) == 160 and max(size for _, _, size in expected) == 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(dart.near_duplicates(docs, store)) == expected


def test_links_of_texts_made_of_common_parts(spark, store):
    choose = random.Random(12)
    parts = [" ".join(f"p{p}w{k}" for k in range(choose.randint(10, 40))) for p in range(18)]
    rows = [(k, " ".join(p for p in parts if choose.random() < 0.72)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute(rows)
    assert len({c for _, c, _ in expected}) > 5
    assert found(dart.near_duplicates(docs, store)) == expected


def test_empty_table(spark, store):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dart.near_duplicates(docs, store).count() == 0


def test_agreement_of_signatures_is_the_weighted_similarity():
    choose = random.Random(1)
    pairs = []
    for _ in range(60):
        base = choose.choices([f"w{k}" for k in range(40)], k=choose.randint(60, 200)) * choose.choice((1, 2))
        pairs += [" ".join(base), " ".join(base[: len(base) * choose.randint(30, 100) // 100])]
    owner, region = dart.regions(*dart.shingles(words_of(*text_bytes(pa.array(pairs)))))
    signed = dart.signatures(owner, region, len(pairs))
    assert np.isfinite(signed).all()
    agreed = (signed[::2] == signed[1::2]).mean(axis=1)
    exact = dart.similarities(pa.array(pairs[::2]), pa.array(pairs[1::2]))
    for k, (a, b) in enumerate(zip(pairs[::2], pairs[1::2])):
        one, other = weights(a), weights(b)
        assert exact[k] == pytest.approx(sum((one & other).values()) / sum((one | other).values()))
    assert abs((agreed - exact).mean()) < 0.02 and np.abs(agreed - exact).max() < 0.2


def test_components_of_chains_and_stars(spark, store):
    links = [(k + 1, k) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(frame, store).collect()}
    expected = {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == expected


def test_near_copies_of_one_text_meet_few_leaders(spark, store):
    """However many bands of theirs are in large buckets."""
    choose = random.Random(13)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(3):
            text[choose.randrange(len(text))] = f"x{choose.randrange(1 << 40)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    pairs, first = [], dart._first_pairs

    def watched(members):
        pairs.append(members.filter(f"_n > {dart.SMALL_BUCKET}"))
        return first(members)

    dart._first_pairs = watched
    try:
        assert found(dart.near_duplicates(docs, store)) == brute(rows)
    finally:
        dart._first_pairs = first
    large = pairs[0]
    assert large.count() > 1000
    assert first(large).count() <= 2 * dart.LEADERS * len(rows)
