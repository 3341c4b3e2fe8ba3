from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from coursemill.llm import phrases
from coursemill.llm.phrases import collocations, frequent_phrases, phrases_of


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def counted(rows):
    found = defaultdict(Counter)
    for lang, text in rows:
        own = found[lang or "und" if lang is None else lang]
        for words in pieces(text):
            own[()] += len(words)
            for n in range(1, 6):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def expected(rows, least, best):
    out = []
    for lang, own in counted(rows).items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        kept = []
        for p, a in candidates.items():
            if inside[p] < a:
                cuts = [(1000 * a * own[()] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, text, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, text.decode(), -a, left, right, own[()], -score))
    return sorted(out)


def sentences(seed, n, words="a b c dd ee Fé x1 ▁ ou ch".split()):
    some = random.Random(seed)
    return [
        (some.choice(["en", "de", None, ""]), "".join(some.choice(words) + some.choice(["  ", " ", "\t", ". ", "\n"]) for _ in range(some.randrange(60))))
        for _ in range(n)
    ]


CASES = {
    "random": sentences(1, 300),
    "repeated": [("en", "One two three four five six")] * 40 + [("en", "two three")] * 3 + [("de", "one two, three")] * 12,
    "odd": [(None, None), ("en", ""), ("en", " .,\n\t "), ("en", "a " * 30_000), ("und", "b b b b b b b b b b b b"), (None, "b b")],
}


@pytest.mark.parametrize("case", CASES)
def test_collocations(spark, store, case):
    rows = CASES[case]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, phrase string").repartition(5)
    found = collocations(table, store, least=8, best=50).collect()
    assert sorted(map(tuple, found)) == expected(rows, 8, 50)


def test_colliding_fingerprints_are_told_apart_by_their_words(spark, store, monkeypatch):
    """With fingerprints of six bits nearly all phrases collide, inside chunks and between them."""
    monkeypatch.setattr(phrases, "mix", lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
    rows = CASES["random"][:120]
    found, stays = [], counted(rows)
    for langs in (rows[:50], rows[50:]):
        one = phrases_of(pa.array([x if x is not None else "und" for x, _ in langs]), pa.array([t for _, t in langs]))
        for n in range(1, 6):
            first, value = one.fingerprints(n)
            different, which = np.unique(value, return_inverse=True)
            assert len(different) <= 64
            found += [(lang, tuple(text.decode().split(" ")), c) for _, lang, text, c in phrases._written(one, n, first, which)]
    total = defaultdict(Counter)
    for lang, words, count in found:
        total[lang][words] += count
    for lang, own in stays.items():
        assert total[lang] == Counter({p: c for p, c in own.items() if p})


def test_frequent_phrases_and_their_order(spark, store):
    rows = CASES["random"]
    table = spark.createDataFrame(rows, "lang string, text string")
    found = {(r["lang"], r["phrase"]): r["a"] for r in frequent_phrases(table, store, least=5).collect()}
    wanted = {(lang, " ".join(p)): a for lang, own in counted(rows).items() for p, a in own.items() if a >= 5 or not p}
    assert found == wanted


def test_counts_beyond_64_bits_stay_exact(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 9_999_999_999_999_999, 9_999_999_999_999_998, 7_777_777_777, 1_234_567_890_123_456
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert row.select(F.expr(phrases.SCORE)).first()[0] == 1000 * a * n // (left * right)


def test_empty_table(spark, store):
    assert collocations(spark.createDataFrame([], "lang string, text string"), store).collect() == []


def test_words_of_a_chunk_take_bounded_memory():
    """Peak bytes per byte of text, without the powers, which a worker keeps."""
    langs, texts = pa.array(["en"] * 64), pa.array(["some words, and others that follow. " * 455] * 64)
    phrases_of(langs, texts)
    tracemalloc.start()
    try:
        phrases_of(langs, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 33 * sum(map(len, texts.to_pylist()))
