from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from coursemill.llm.common import read_table
from coursemill.llm.piece_codec import decode, encode, round_trip
from coursemill.llm.piece_models import PieceModel
from coursemill.llm.token_counts import prefix_counts, token_counts, truncated

PARTS = ["a", "the", " ", "  ", "\n", "é", "中", "<s>", "<0x41>", "x", "12", "ing", "🙂", "́", ".", "!!", "in", "er", "\t", "\x00", "tion"]


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def unigram(fallback: bool) -> bytes:
    """A small unigram model in the library's format, put together by hand."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256 if fallback else 0):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for k, piece in enumerate(["▁", "a", "the", "▁the", "th", "e", "h", "t", "in", "▁in", "ing", "n", "i", "er", "ti", "on", "tion", "12", "1", "!!", "▁▁", "é"]):
        proto.pieces.add(piece=piece, score=-1 - 0.37 * k, type=1)
    return proto.SerializeToString()


def samples(n, seed=0):
    choose = random.Random(seed)
    return ["".join(choose.choices(PARTS, k=choose.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["bpe", "unigram with bytes", "unigram"])
def test_ids_are_those_of_the_library(bpe, kind):
    serialized = bpe if kind == "bpe" else unigram("bytes" in kind)
    ours, library = PieceModel(serialized), sentencepiece.SentencePieceProcessor(model_proto=serialized)
    for text in samples(3000):
        if kind == "unigram" and any(a not in ours.ids for a in text.replace(" ", "▁")):
            continue  # runs of unknown characters are compared below
        ids = np.frombuffer(ours.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text
        assert ours.count(text) == len(ids)
        assert ours.decode(ids) == text
    assert np.frombuffer(ours.encode("a中中 the"), "<i4").tolist() == library.encode("a中中 the")


def test_merging_by_definition_is_the_automaton_result(bpe):
    model = PieceModel(bpe)
    for text in samples(300, 5):
        for unit in model.units(text):
            assert model.tokens(unit) == model.merged(unit)


def test_every_prefix_has_its_exact_count(bpe):
    model, library = PieceModel(bpe), sentencepiece.SentencePieceProcessor(model_proto=bpe)
    for text in samples(150, 9):
        assert model.counts_by_prefix(text).tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


ROWS = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (None, "a  b "), (4, "caté " * 60_000), (5, "<s>▁x")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, [3, 100, -1, None], 7) for r in rows], "doc_id bigint, text string, ids array<int>, n_tokens int")


def test_tables(spark, bpe):
    library = sentencepiece.SentencePieceProcessor(model_proto=bpe)
    docs = table(spark)
    by_text = {r["doc_id"]: r["ids"] for r in encode(docs, bpe).collect()}
    for i, text in ROWS:
        assert by_text[i] == library.encode(text or "")
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs, bpe), bpe).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in ROWS}
    trips = {r["doc_id"]: r["round_trip"] for r in round_trip(docs, bpe).collect()}
    assert trips == {1: True, 2: True, 3: True, None: True, 4: True, 5: False}
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, bpe).collect()}
    assert counted == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS}
    asked = {r["doc_id"]: r["n_tokens"] for r in prefix_counts(docs, bpe, "ids").collect()}
    assert asked[1] == [len(library.encode("the")), len(library.encode("the cat sat")), 0, 0]
    for r in truncated(docs, bpe, 5).collect():
        text = dict(ROWS)[r["doc_id"]]
        best = max(k for k in range(min(len(text or ""), 100) + 1) if len(library.encode((text or "")[:k])) <= 5)
        assert (r["text"] or "") == (text or "")[:best] and r["n_tokens"] == len(library.encode((text or "")[:best]))


def test_empty_table(spark, bpe):
    for work in (encode, round_trip, token_counts):
        assert work(table(spark, []), bpe).count() == 0


def test_documents_are_counted_as_by_the_library(spark, bpe):
    library = sentencepiece.SentencePieceProcessor(model_proto=bpe)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, bpe).collect()}
    assert counted == {r["doc_id"]: len(library.encode(r["text"])) for r in docs.collect()}


def test_units_remembered_by_a_worker_are_bounded():
    """Two generations of them, far below what an executor's workers can hold together."""
    from coursemill.llm.piece_models import Remembered

    units = Remembered(lambda unit: b"ids")
    for k in range(1_000_000):
        units[f"unit{k}"]
        if k % 10_000 == 0:
            units.trim()
    assert len(units) + len(units.old) < 400_000
