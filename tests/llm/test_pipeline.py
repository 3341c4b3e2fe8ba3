from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as driver
import corpus_pipeline
from coursemill.llm.common import read_table
from coursemill.llm.dart_minhash import near_duplicates
from coursemill.llm.toxicity import TOXIC_FROM, learn, toxicity
from tests.llm.test_dart import brute as classes
from tests.llm.test_exact import expected as groups
from tests.llm.test_winnow import brute as contaminated

SMALL = "/root/testdata/sf0.001"


def test_stages_over_documents(spark, store):
    docs = read_table(spark, SMALL, "documents")
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SMALL, "benchmark").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    stages = dict(corpus_pipeline.STAGES)
    before = docs
    for name, wanted in (
        ("toxicity", None),
        ("exact dedup", lambda rows: {g[0] for g in groups(rows) if g[3]}),
        ("minhash near-dedup", lambda rows: {c[0] for c in classes(rows) if c[0] == c[1]}),
        ("benchmark decontamination", lambda rows: {c[0] for c in contaminated(rows, items) if not c[2]}),
    ):
        after = store.keep(stages[name](spark, before, SMALL), "stage")
        assert after.schema == docs.schema
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if wanted is None:
            scores = toxicity(before, learn(before, read_table(spark, SMALL, "labels"))).collect()
            kept = {r["doc_id"] for r in scores if r["score"] < TOXIC_FROM}
            assert len(kept) > 0.7 * len(rows)
        else:
            kept = wanted(rows)
        left = after.collect()
        assert {r["doc_id"] for r in left} == kept and len(left) == len(kept)
        assert {tuple(r) for r in left} <= {tuple(r) for r in docs.collect()}
        before = after
    coded = stages["sentencepiece encoding"](spark, before, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["ids"] for r in coded} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded)


def test_run_is_all_stages(spark):
    found = driver.queries()["pipeline"](spark, SMALL)
    assert found.columns == ["doc_id", "ids", "n_tokens"] and 0 < found.count() < 200


def test_rows_that_are_odd(spark, store):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (4, "z " * 50_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, read_table(spark, SMALL, "documents").schema)
    kept = corpus_pipeline.drop_copies(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() > 0
    assert near_duplicates(docs, store).count() == 7


def test_near_copies_with_shared_or_no_ids_and_clashing_names(spark):
    words = [f"w{k}" for k in range(200)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (3, 50, 120)]
    far = [" ".join(f"{c}{k}" for k in range(50)) for c in "xyz"]
    rows = [(7, near[0]), (7, near[1]), (None, near[2]), (None, far[0]), (None, far[0] + " more"), (8, far[1]), (8, far[2]), (9, None), (None, "")]
    rows = [(*r, "a", 1, 2, b"x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, _named int, _digest int, row binary")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.collect()]
    assert set(left) <= set(rows) and len(left) == 6
    assert sorted(r[0] for r in left if r[0] is not None) == [7, 8, 8, 9]
    assert [r[1] in (far[0], far[0] + " more", "") for r in left if r[0] is None] == [True, True]
    assert corpus_pipeline.drop_copies(spark, docs.withColumnRenamed("row", "_no_id"), SMALL).count() == 8


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_is_registered(number):
    names = [n for n in driver.queries() if n.startswith(f"op{number}_")]
    assert len(names) == 1 and np.isin(names, list(driver.oracle_sql())).any() == (number in (1, 2, 9, 12, 13))
