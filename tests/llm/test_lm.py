from __future__ import annotations

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from coursemill.llm import attention, lm
from coursemill.llm.attention import BLOCK, DIM, Model, gradients, huffman, log_probabilities, new_params, score, states

SERIALIZED = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for blank in BLANKS:
        low = low.replace(blank, " ")
    return [w for w in low.split(" ") if w]


def learned(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def base(rows):
    """The contract, word by word."""
    counts = Counter()
    for i, text in rows:
        if learned(i):
            counts.update([*words(text), None])
    n, v = counts.total(), len(counts)
    found = []
    for i, text in rows:
        tokens = [*words(text), None]
        value = sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in tokens)
        found.append((i, not learned(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, value))
    return found


def slowly(model, inputs, targets):
    """Logarithm of the probability of each target, one window and one path at a time."""
    p, found = model.params, []
    for at, target in enumerate(targets):
        block = at // BLOCK
        seen = range(max(0, (block - 1) * BLOCK), at + 1)
        query = p["query"][inputs[at]]
        scores = np.array([query @ p["key"][inputs[s]] / DIM**0.5 + p["distance"][at - s] for s in seen])
        weight = np.exp(scores - scores.max())
        value = (weight / weight.sum()) @ np.array([p["value"][inputs[s]] for s in seen])
        state = np.tanh(value @ p["mix"] + p["last"][inputs[at]])
        path = slice(model.paths.starts[target], model.paths.starts[target + 1])
        total = 0.0
        for node, sign in zip(model.paths.nodes[path], model.paths.signs[path]):
            total -= np.log1p(np.exp(-sign * (model.paths.odds[node] + p["node"][node] @ state)))
        found.append(total)
    return np.array(found)


def some_model(size=40, seed=3):
    random = np.random.default_rng(seed)
    params = new_params(size, seed)
    params["node"] = random.standard_normal(params["node"].shape).astype(np.float32)
    params["distance"] = random.standard_normal(2 * BLOCK).astype(np.float32)
    return Model(params, huffman(random.integers(0, 50, size)))


def test_probabilities_of_all_ids_add_up_to_one():
    model = some_model()
    state = np.random.default_rng(1).standard_normal((1, DIM)).astype(np.float32)
    found = [log_probabilities(model, state, np.array([i]))[0] for i in range(40)]
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-5)


def test_without_states_the_tree_gives_the_shares_of_the_counts():
    counts = np.array([5, 0, 100, 7])
    model = Model(new_params(4, 0), huffman(counts))
    found = log_probabilities(model, np.zeros((4, DIM), np.float32), np.arange(4))
    assert np.exp(found) == pytest.approx((counts + 1) / (counts + 1).sum(), rel=1e-5)


def test_every_id_is_scored_once_in_its_window(monkeypatch):
    model, random = some_model(), np.random.default_rng(5)
    lengths = np.array([1, 15, 16, 17, 100, 2, 64, 33])
    ids = random.integers(0, 40, lengths.sum())
    targets = random.integers(0, 40, lengths.sum())
    ends = np.cumsum(lengths)
    wanted = np.concatenate([slowly(model, ids[e - n : e], targets[e - n : e]) for n, e in zip(lengths, ends)])
    assert score(model, ids, targets, lengths) == pytest.approx(wanted, abs=1e-4)
    monkeypatch.setattr(attention, "TOGETHER", 2 * BLOCK)  # blocks that are worked on apart see the same before them
    assert score(model, ids, targets, lengths) == pytest.approx(wanted, abs=1e-4)


def test_nothing_later_and_no_other_text_is_seen():
    model, random = some_model(), np.random.default_rng(6)
    inputs = random.integers(0, 40, (4, BLOCK))
    first = np.array([True, False, True, False])
    before = states(model.params, inputs, first)
    changed = inputs.copy()
    changed[1, 5:] = (changed[1, 5:] + 1) % 40
    after = states(model.params, changed, first)
    assert np.array_equal(before[0], after[0]) and np.array_equal(before[1, :5], after[1, :5])
    assert np.array_equal(before[2:], after[2:]) and not np.allclose(before[1, 5:], after[1, 5:])


def test_gradients_are_those_of_the_loss():
    model, random = some_model(), np.random.default_rng(7)
    for name in model.params:
        model.params[name] = model.params[name].astype(np.float64)
    inputs, targets = random.integers(0, 40, (2, 4, BLOCK))
    first, scored = np.array([True, False, True, False]), random.random((4, BLOCK)) < 0.8
    _, found = gradients(model, inputs, first, targets, scored)
    for names, (rows, values) in found.items():
        for i, name in enumerate(names):
            whole = np.zeros_like(model.params[name])
            width = values.shape[-1] // len(names)
            own = values[..., i * width : (i + 1) * width]
            if rows is None:
                whole += own
            else:
                np.add.at(whole, rows, own)
            for at in zip(*(random.integers(0, n, 4) for n in whole.shape)):
                kept, losses = model.params[name][at], []
                for step in (1e-2, -1e-2):
                    model.params[name][at] = kept + step
                    losses.append(gradients(model, inputs, first, targets, scored)[0])
                model.params[name][at] = kept
                assert whole[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-5)


ROWS = [
    (1, "The cat sat.\tthe CAT\x0bran"),
    (2, None),
    (3, ""),
    (4, "Ärger ÄRGER the cat ▁odd▁ word"),
    (5, "the " * 20_000 + "end"),
    (None, "the cat"),
    (1, "the cat"),
    *((i, f"cat number {i % 5} sat on the mat {'again ' * (i % 40)}") for i in range(10, 80)),
]


@pytest.fixture(scope="module")
def scored(spark, store):
    table = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id bigint, text string, score string, _id int")
    patch = pytest.MonkeyPatch()
    patch.setattr(lm, "STEPS", 200)
    try:
        return lm.lm_scores(table, SERIALIZED, store).collect()
    finally:
        patch.undo()


def test_counts_and_base_scores(scored):
    wanted = sorted(base(ROWS), key=lambda r: (str(r[0]), r[2]))
    found = sorted((tuple(r)[:6] for r in scored), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in wanted], rel=1e-9)


def test_scores_are_those_of_single_texts(spark, store, monkeypatch):
    """The registered way, through chunks, against the library's ids and one text at a time."""
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    kept = []
    monkeypatch.setattr(lm, "STEPS", 50)
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.lm_scores(table, SERIALIZED, store).collect())
    library = sentencepiece.SentencePieceProcessor(model_proto=SERIALIZED)
    wanted = []
    for i, text in ROWS:
        if len(text or "") < 10_000:
            ids = [1, *(x for w in words(text) for x in library.encode(w)), 2]
            wanted.append((str(i), len(words(text)) + 1, slowly(kept[0], ids[:-1], ids[1:]).sum() / math.log(10)))
    found = [r for r in found if r[1] < 10_000]
    assert [r[:2] for r in found] == [r[:2] for r in sorted(wanted)]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in sorted(wanted)], rel=1e-4)


def test_held_out_texts_of_the_given_table(spark, store):
    """Subword ids cost little more than words by add-one counts even where few texts are learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lm.lm_scores(docs, SERIALIZED, store).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)


def test_empty_table_and_nothing_to_learn_from(spark, store):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.lm_scores(empty, SERIALIZED, store).collect() == []
    held = next(i for i in range(100) if not learned(i))
    (row,) = lm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string"), SERIALIZED, store).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["held_out"] and row["score"] < 0


@pytest.mark.parametrize("shared", [1, 1000])
def test_gradients_by_id_are_those_target_by_target(monkeypatch, shared):
    model, random = some_model(), np.random.default_rng(8)
    inputs, targets = random.integers(0, 40, (2, 20, BLOCK))
    first, scored = random.random(20) < 0.5, random.random((20, BLOCK)) < 0.8
    first[0] = True

    def found():
        loss, by_name = gradients(model, inputs, first, targets, scored)
        nodes = np.zeros_like(model.params["node"])
        np.add.at(nodes, by_name[("node",)][0], by_name[("node",)][1])
        return loss, nodes, by_name[("query", "key", "value", "last")][1]

    wanted = found()
    monkeypatch.setattr(attention, "SHARED", shared)
    for one, other in zip(found(), wanted):
        assert one == pytest.approx(other, abs=1e-6)


def nodes_to(paths, rows, keep):
    """Nodes on the paths to the ids of these texts and their ends."""
    library = sentencepiece.SentencePieceProcessor(model_proto=SERIALIZED)
    ids = {2, *(x for i, text in rows if keep(i) for w in words(text) for x in library.encode(w))}
    return {n for x in ids for n in paths.nodes[paths.starts[x] : paths.starts[x + 1]].tolist()}


@pytest.mark.parametrize("learner", [8 << 20, 1000])
def test_the_network_learns_every_id_of_every_text(spark, store, monkeypatch, learner):
    """One learner with several passes, and several learners in rounds."""
    random = np.random.default_rng(9)

    def text(n):
        return " ".join("".join(random.choice([*"abcdefghijklmnop"], 6)) for _ in range(n))

    long = next(i for i in range(1000, 2000) if learned(i))
    rows = [(i, text(40)) for i in range(60)] + [(long, text(4000)), (2001, None), (2002, "")]
    kept, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    monkeypatch.setattr(lm, "STEPS", 20 if learner > 1000 else 1)
    monkeypatch.setattr(lm, "LEARNER", learner, raising=False)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert lm.lm_scores(table, SERIALIZED, store).count() == len(rows)
    (model,) = kept
    changed = set(np.flatnonzero(model.params["node"].any(axis=1)).tolist())
    assert changed == nodes_to(model.paths, rows, learned) and nodes_to(model.paths, rows, lambda i: True) > changed


def test_changes_are_averaged_over_the_learners_that_made_them():
    one, other = np.full((2, 2 * DIM), 1, np.float32), np.full((2, 2 * DIM), -3.5, np.float32)
    packed = [lm._pack_changes(np.array([4, 9]), one), lm._pack_changes(np.array([9, 12]), other)]
    key = (pa.scalar(0, pa.int32()),)
    (found,) = lm._average(key, pa.table({"part": [0, 0], "packed": packed})).column("packed").to_pylist()
    rows, changes = lm._unpack_changes(found)
    assert rows.tolist() == [4, 9, 12] and np.array_equal(changes[:, 0], np.array([1, -1.25, -3.5], np.float32))


@pytest.mark.parametrize("step", [1, 16, 48, 1000])
def test_steps_meet_every_target_once_after_the_text_before_it(monkeypatch, step):
    model, random = some_model(), np.random.default_rng(10)
    lengths = np.array([1, 15, 16, 17, 100, 2, 64, 33, 400])
    ids, ends = random.integers(0, 40, (lengths + 1).sum()), np.cumsum(lengths + 1)
    last = np.isin(np.arange(len(ids)), ends - 1)
    lost, met = [], []
    plain = attention.gradients

    def spied(*given):
        loss, found = plain(*given)
        lost.append(loss * given[-1].sum())
        return loss, found

    monkeypatch.setattr(attention, "gradients", spied)
    optimizer = attention.Adagrad(model.params, {k: np.full_like(v, 1e-8) for k, v in model.params.items()})
    attention.steps_over(model, optimizer, attention.blocks(ids, lengths), step, random, lambda n: met.append(n) or 0.0)
    assert sum(met) == lengths.sum()
    assert -sum(lost) == pytest.approx(score(model, ids[~last], ids[np.flatnonzero(~last) + 1], lengths).sum(), rel=1e-4)
