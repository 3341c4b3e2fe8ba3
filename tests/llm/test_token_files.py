from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coursemill.llm import queries, token_files
from coursemill.llm.common import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "The", "é", "É.", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'", "!!", ",", ".", "1", "23", "\n", " ", "  ",
    " ", "…", "́", "中文", "x²", "ß", "İ", "ΑΣ", "\x1c", "🙂", "$$$", "K.", "á.", "¿", "÷,",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 200)
    encoder, choose = token_files.WordEncoder(PATH), random.Random(2)
    for _ in range(300):
        texts = ["".join(choose.choices(PARTS, k=choose.randint(0, 12))) for _ in range(10)]
        wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [list(array("I", x)) for x in encoder.encode(texts)] == wanted


ROWS = [(3, "hello world"), (1, None), (2, ""), (None, "x"), (3, "another, text"), (3, "hello world"), (4, "w1 " * 100_000)]


@pytest.mark.parametrize("end_id", [1, 70_000])
def test_round_trip(spark, store, library, end_id):
    docs = spark.createDataFrame([(*r, 0, "y") for r in ROWS], "doc_id bigint, text string, start int, ids string")
    out = store.fresh_path("tokens")
    manifest = token_files.write_token_files(docs.repartition(3), out, store, PATH, end_id, shards=3)
    found = sorted(token_files.read_token_files(out, manifest, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 3, 3, 4]
    ids = {i: sorted([*library.encode(t or "", add_special_tokens=False).ids, end_id] for j, t in ROWS if j == i) for i, _ in ROWS}
    start = 0
    for r in found:
        own = list(array("I", r["ids"]))
        assert own in ids[r["doc_id"]] and (r["start"], r["n_tokens"]) == (start, len(own))
        start += len(own)
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    assert [s["base"] for s in shards] == [sum(s["n_ids"] for s in shards[:k]) for k in range(len(shards))]
    assert sum(s["n_ids"] for s in shards) == start
    for s in shards:
        places = np.fromfile(f"{out}/{s['file']}.offsets", "<u8")
        flat = np.fromfile(f"{out}/{s['file']}.ids", "<u2" if end_id == 1 else "<u4")
        assert len(flat) == places[-1] == s["n_ids"] and len(places) == s["n_docs"] + 1 and places[0] == 0


def test_empty_table(spark, store):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    out = store.fresh_path("tokens")
    manifest = token_files.write_token_files(docs, out, store, PATH, 1, shards=2)
    assert token_files.read_token_files(out, manifest, 2).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    start, wanted = 0, []
    for r in sorted(read_table(spark, folder, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.token_binary(spark, folder).collect())) == wanted
