from __future__ import annotations

import zlib

from coursemill.llm.common import read_table
from coursemill.llm.langid import DICTIONARY_BYTES, Classifier, identify, learn_dictionaries


def test_accuracy_on_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    dictionaries = learn_dictionaries(docs)
    assert set(dictionaries) == {"de", "en", "es", "fr"} and all(len(d) <= DICTIONARY_BYTES for d in dictionaries.values())
    rows = identify(docs, dictionaries).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    sure = [r for r in rows if not r["rejected"]]
    assert sum(r["lang"] == r["lang_pred"] for r in sure) / len(sure) > 0.97


def test_smallest_encoding_wins():
    classifier = Classifier({"a": b"the quick brown fox " * 50, "b": b"der schnelle braune fuchs " * 50})
    text = b"the quick brown fox " * 400
    sizes = classifier.sizes(text)
    assert sizes[0] < sizes[1] and classifier.predict(text.decode())[0] == "a"
    assert classifier.predict("der schnelle braune fuchs")[0] == "b"
    assert Classifier({"a": b"x", "b": b"x"}).predict("unlike either") == ("a", 0.0, True)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "letters", None), (4, "the thing", "en"), (4, "the thing", "en"), (5, "ä" * 200_000, "xx")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, score double")
    found = identify(docs, learn_dictionaries(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3))
    nothing = identify(docs, {}).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and all(r["rejected"] for r in nothing)
    assert identify(docs.limit(0), {}).count() == 0
