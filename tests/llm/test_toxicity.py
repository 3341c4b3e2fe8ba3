from __future__ import annotations

import zlib

import numpy as np

from coursemill.llm import gru, toxicity as tox
from coursemill.llm.common import held_out, read_table, text_bytes, words_of

import pyarrow as pa


def some_windows(n=5):
    random = np.random.default_rng(1)
    p = gru.new_params(20, 2)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    tables = [random.standard_normal((30, 3 * gru.STATE)) for _ in range(2)]
    at = random.integers(0, 30, (7, n))
    mask = (np.arange(7)[:, None] < random.integers(1, 8, n)[None, :]).astype(float)
    projected = np.stack([t[at] for t in tables], axis=1)
    return p, tables, at, mask, projected


def test_both_ways_to_score_agree():
    p, tables, at, mask, projected = some_windows()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    tables = [t.astype(np.float32) for t in tables]
    slow = gru.forward(p, projected.astype(np.float32), mask.astype(np.float32))
    np.testing.assert_allclose(gru.logits(p, tables, at, mask.astype(np.float32)), slow, atol=1e-5)


def test_gradient_by_differences(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)
    p, _, _, mask, projected = some_windows()
    weight = np.linspace(-1, 1, 5)
    _, kept = gru.forward(p, projected, mask, keep=True)
    g, d_projected = gru.gradient(p, kept, weight)

    def loss():
        return float((gru.forward(p, projected, mask) * weight).sum())

    for array, slope in [*((p[k], g[k]) for k in g), (projected, d_projected)]:
        flat = array.reshape(-1)
        for at in np.random.default_rng(0).integers(0, flat.size, 6):
            before = flat[at]
            flat[at] = before + 1e-5
            up = loss()
            flat[at] = before - 1e-5
            down = loss()
            flat[at] = before
            assert abs((up - down) / 2e-5 - slope.reshape(-1)[at]) < 1e-5


def test_windows_cover_every_word():
    text, start = tox.windows_of(np.array([0, 1, 32, 33, 100]))
    for t, n in enumerate([0, 1, 32, 33, 100]):
        own = start[text == t]
        covered = {k for s in own for k in range(s, min(n, s + tox.WINDOW))}
        assert covered == set(range(n)) and (np.diff(own) < tox.WINDOW).all()


def test_held_out_texts_with_words_and_spellings_never_seen(spark):
    random = np.random.default_rng(5)
    calm = ["house", "tree", "river", "stone", "cloud", "bread", "window", "letter"]
    bad = ["grobst", "grobar", "groblin", "grobo", "grobix"]
    data = []
    for k in range(400):
        words = list(random.choice(calm, random.integers(20, 200)))
        if k % 4 == 0:
            for _ in range(3):
                words[random.integers(len(words))] = bad[k % 5] if k < 300 else "grobunu"
        data.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "x", 9.0) for i, t, _ in data], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 300] + [(1, None), (0, 0)], "doc_id bigint, toxic int")
    model = tox.learn(docs, labels)
    found = {r["doc_id"]: r for r in tox.toxicity(docs, model).collect()}
    for i, _, y in data:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (found[i]["score"] >= tox.TOXIC_FROM) == bool(y)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "..."), (None, "a"), (4, "bad word"), (4, "bad word"), (5, "w " * 100_000)],
        "doc_id bigint, text string",
    )
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tox.learn(docs, none)
    found = tox.toxicity(docs, model).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert [r["score"] for r in found if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert tox.toxicity(docs.limit(0), model).count() == 0
    one = tox.train(["a b", "c"], np.array([1, 1], np.float32))
    words = words_of(*text_bytes(pa.array(["a", "zzz"])))
    assert (tox.score_windows(one, words)[2] > 0.9).all()
    assert held_out  # rows that are learned from are the others


def test_accuracy_on_held_out_documents(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    scored = tox.toxicity(docs, tox.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["score"] for r in scored if r["toxic"]]
    calm = [r["score"] for r in scored if not r["toxic"]]
    ranked = np.mean([(t > c) + (t == c) / 2 for t in toxic for c in calm])
    assert ranked > 0.8 and np.mean([c >= tox.TOXIC_FROM for c in calm]) < 0.1


def test_every_passage_of_sixteen_words_lies_whole_in_a_window():
    for words in (16, 40, 100, 333):
        _, starts = tox.windows_of(np.array([words]))
        for at in range(words - 15):
            assert any(s <= at and at + 16 <= s + tox.WINDOW for s in starts)


def test_texts_that_are_carried_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (4, "grob " * 99, 8)], "doc_id bigint, text string, n int")
    model = tox.Model(gru.new_params(0, 3), np.zeros(0, np.uint64))
    plain = sorted(tox.toxicity(docs, model).collect())
    carried = tox.toxicity(docs, model, carry=True)
    assert sorted(r[:4] for r in carried.collect()) == [tuple(r) for r in plain]
    assert sorted(r["row"] for r in carried.collect()) == sorted(docs.collect())
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS _text" in plan


def test_workers_forget_what_other_operators_left():
    from coursemill.llm import common, piece_models
    from coursemill.llm.queries import piece_model

    codec = piece_models.model(piece_model())
    assert piece_models.model(piece_model()) is codec
    common.keep_only("pieces")
    assert piece_models.model(piece_model()) is codec
    common.powers(10)
    common.keep_only("powers")
    assert piece_models.model(piece_model()) is not codec and common.remembered("powers")
