from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
import pytest

from checks.compare import connect, difference
from coursemill.llm import oracles, queries
from coursemill.llm.warc import GZIP, RecordStream, base32_sha1, inflated, normalise, read_records, write_archives

PAGES = [
    (5, "http://a/5", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (9, None, None),
    (7, "http://a/7\r\nX: y", ""),
    (8, "http://ä/8", "é\r\n\r\nWARC/1.1\r\n" * 3),
    (None, "http://a/null", "<p>one</p>"),
    (10, "http://a/10", "x" * 3_000_000),
    (2, "http://a/2", "<p>one</p>"),
]


def archived(spark, store, rows, least=0):
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id bigint, url string, html string, file int, _first string")
    streams, members = store.fresh_path("streams"), store.fresh_path("members")
    files = write_archives(pages.repartition(2), streams, store, least_bytes=least)
    return files, streams, normalise(files, streams, members, store, 2), members


def test_round_trip(spark, store):
    files, streams, index, members = archived(spark, store, PAGES)
    found = read_records(index, members, 2).collect()
    assert len(found) == len(PAGES) == index.count()
    text = {"" if i is None else str(i): html or "" for i, _, html in PAGES}
    firsts = {"<p>one</p>": "2", "": "7"}
    for r in found:
        payload = text[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload.encode()), base32_sha1(payload.encode()))
        first = firsts.get(payload, r["page_id"])
        assert r["record_type"] == ("response" if first == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if first == r["page_id"] else first)
        assert r["html"] == (payload if r["record_type"] == "response" else None)


def test_files(spark, store):
    files, streams, index, members = archived(spark, store, PAGES)
    whole = b""
    for row in files.collect():
        with open(f"{streams}/{row['file']}", "rb") as file:
            data = file.read()
        # One stream each, which has to be inflated from its beginning.
        inflate = zlib.decompressobj(GZIP)
        whole += inflate.decompress(data)
        assert inflate.eof and not inflate.unused_data
    joined = b""
    for row in sorted(index.collect(), key=lambda r: (r["file"], r["place"])):
        with open(f"{members}/{row['file']}", "rb") as file:
            file.seek(row["place"])
            joined += gzip.decompress(file.read(row["length"]))
    assert sorted(joined.split(b"WARC/1.1\r\n")) == sorted(whole.split(b"WARC/1.1\r\n"))


def test_least_size_of_a_revisit(spark, store):
    _, _, index, members = archived(spark, store, PAGES, least=1)
    kinds = {(r["page_id"], r["record_type"]) for r in read_records(index, members, 2, with_html=False).collect()}
    assert ("9", "response") in kinds and ("7", "response") in kinds and ("5", "revisit") in kinds


def test_empty_table(spark, store):
    _, _, index, members = archived(spark, store, [])
    assert index.count() == 0 and read_records(index, members, 2).count() == 0


def test_parts_of_any_size():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"a" * n + b"\r\n\r\n" for n in (0, 1, 5000, 7)]
    data = gzip.compress(records[0] + records[1]) + gzip.compress(records[2] + records[3])
    stream = RecordStream()
    parts = [bytes(p) for p in inflated(pa.BufferReader(data))]
    assert b"".join(parts) == b"".join(records)
    found = [r for part in b"".join(parts) for _, r in stream.feed(bytes([part]))]
    assert found == records and not stream.left


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_decontamination", "op9_warc"])
def test_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.llm_queries()[name](spark, folder), connect(folder), oracles.llm_oracles()[name]) is None
