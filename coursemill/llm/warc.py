"""WARC archives: written as one gzip stream per file, normalised to a gzip member per record with an index.

A file of the first kind has to be inflated from its beginning to reach any record. ``normalise`` inflates
each file once, as a stream, and writes every record as a member of its own, together with a sidecar index
of places, so that a reader can go to any record directly.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.store import Store

from .common import filesystem, join_path, make_folder, pieces, ship

#: Level of both kinds of gzip files; 31 window bits stand for the gzip format.
LEVEL, GZIP = 6, 31
READ_BYTES = 1 << 20
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return "".join(text.splitlines()).strip()


def record(page_id: str, url: str, payload: bytes, refers_to: str | None, refers_to_url: str) -> bytes:
    """A response, or a revisit, which has the HTTP headers of the page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if refers_to is not None else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[3:3] = [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_to)}>"),
            ("WARC-Refers-To-Target-URI", _one_line(refers_to_url)),
            ("WARC-Refers-To-Page-ID", refers_to),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class RecordStream:
    """Records of a stream of inflated bytes, which come in parts of any size."""

    def __init__(self) -> None:
        self.left = bytearray()

    def feed(self, part: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.left += part
        done = 0
        while (end := self.left.find(b"\r\n\r\n", done)) >= 0:
            fields = headers(bytes(self.left[done:end]))
            stop = end + 4 + int(fields["content-length"]) + 4
            if len(self.left) < stop:
                break
            yield fields, bytes(self.left[done:stop])
            done = stop
        del self.left[:done]


def inflated(stream: pa.NativeFile) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a bounded part at a time."""
    inflate = zlib.decompressobj(GZIP)
    while part := stream.read(READ_BYTES):
        while part:
            yield inflate.decompress(part, READ_BYTES)
            part = inflate.unconsumed_tail
            if inflate.eof:
                part = inflate.unused_data
                inflate = zlib.decompressobj(GZIP)
    yield inflate.flush()


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed, for the exchange."""
    press = zstandard.ZstdCompressor(level=3)
    for piece in (p for b in batches for p in pieces(b, 2)):
        packed = [press.compress((x or "").encode()) for x in piece.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), piece.column(3), piece.column(4), pa.array(packed, pa.binary())],
            names=["_id", "_url", "_sha", "_size", "_packed"],
        )


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``_id``, ``_url`` and ``_packed`` (the payload, compressed) of pages, with ``_first`` and ``_first_url``: the page
    they revisit, null for responses.

    Pages with equal payloads of at least ``least_bytes`` bytes revisit the one of the smallest id. The pages
    are put together by the payload's SHA-256 before anything is shuffled; a payload that a third of all
    pages have is one row per task. Null ids come after all others, and of pages that repeat an id each is
    a response if one is. Null payloads are empty.
    """
    payload = F.coalesce(F.col("_html"), F.lit("")).cast("binary")
    rows = pages.withColumn("_sha", F.unhex(F.sha2(payload, 256))).withColumn("_size", F.octet_length(payload).cast("bigint"))
    firsts = rows.groupBy("_sha").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_url")).alias("_from"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _url string, _sha binary, _size bigint, _packed binary"
    both = rows.select("_id", "_url", "_html", "_sha", "_size").mapInArrow(_pressed, schema).join(firsts, "_sha")
    revisit = (F.col("_size") >= least_bytes) & ~F.col("_id").eqNullSafe(F.col("_from._id"))
    return both.select(
        "_id",
        "_url",
        "_packed",
        F.when(revisit, F.col("_from._id")).alias("_first"),
        F.when(revisit, F.col("_from._url")).alias("_first_url"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    store: Store,
    least_bytes: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Write every page as a record into gzip files of a single stream; returns their names (``file``).

    Each task writes one file. Names carry a mark of the attempt and the returned table is written once the
    files are whole, so files of lost or repeated tasks are never read. Ids are kept as text in the records;
    a null id is written as ''. Other columns are ignored, an empty table makes no file.
    """
    ship(pages.sparkSession)
    make_folder(folder)
    rows = pages.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(url_column), F.lit("")).alias("_url"),
        F.col(html_column).alias("_html"),
    )
    rows = with_revisits(rows, least_bytes).select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"),
        "_url",
        "_packed",
        F.col("_first").cast("string").alias("_first"),
        F.coalesce("_first_url", F.lit("")).alias("_first_url"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, f"pages-{uuid.uuid4().hex}.warc.gz"
        deflate, inflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), zstandard.ZstdDecompressor()
        for piece in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            if out is None:
                system, path = filesystem(join_path(folder, name))
                out = system.open_output_stream(path, compression=None)
            for row in piece.to_pylist():
                one = record(row["_id"], row["_url"], inflate.decompress(row["_packed"]), row["_first"], row["_first_url"])
                out.write(deflate.compress(one))
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return store.keep(rows.mapInArrow(write, "file string"), "archives")


INDEX = "file string, page_id string, record_type string, place bigint, length bigint"


def normalise(files: DataFrame, folder: str, out_folder: str, store: Store, tasks: int) -> DataFrame:
    """Rewrite each file with a gzip member per record; returns the index (``INDEX``), written as a table.

    A file is inflated once from its beginning, a bounded part at a time; a task holds one record. The index
    names only files that were finished.
    """
    ship(files.sparkSession)
    make_folder(out_folder)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source in (x for b in batches for x in b.column(0).to_pylist()):
            name = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
            entries, place, records = [], 0, RecordStream()
            system, path = filesystem(join_path(folder, source))
            out_system, out_path = filesystem(join_path(out_folder, name))
            with (
                system.open_input_stream(path, compression=None) as stream,
                out_system.open_output_stream(out_path, compression=None) as out,
            ):
                for part in inflated(stream):
                    for fields, whole in records.feed(part):
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = deflate.compress(whole) + deflate.flush()
                        out.write(member)
                        entries.append((name, fields["warc-page-id"], fields["warc-type"], place, len(member)))
                        place += len(member)
            if records.left:
                raise ValueError(f"{source} ends inside a record")
            for at in range(0, len(entries), 10_000):
                part = list(zip(*entries[at : at + 10_000]))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(part, kinds)],
                    names=["file", "page_id", "record_type", "place", "length"],
                )

    return store.keep(files.repartition(tasks, "file").mapInArrow(rewrite, INDEX), "archive-index")


READ = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, html string"


def read_records(index: DataFrame, folder: str, tasks: int, with_html: bool = True) -> DataFrame:
    """Every record of the index, read from its place: id, size and digest of the full payload, type, reference.

    The members of a file are read in order of place by one task. A response's payload is checked against
    its digest and length; a revisit has none, and its figures are those its headers state. ``html`` is the
    payload of responses (null for revisits, or when it is not asked for).
    """

    ship(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = "", None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["file"] != opened:
                    if stream is not None:
                        stream.close()
                    opened = entry["file"]
                    system, path = filesystem(join_path(folder, opened))
                    stream = system.open_input_file(path)
                member = zlib.decompress(stream.read_at(entry["length"], entry["place"]), GZIP)
                rows.append(_parsed(member, with_html))
                if sum(len(r[5] or "") for r in rows[-200:]) > READ_BYTES:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        if stream is not None:
            stream.close()

    ordered = index.select("file", "place", "length").repartition(tasks, "file").sortWithinPartitions("file", "place")
    return ordered.mapInArrow(read, READ)


def _parsed(member: bytes, with_html: bool) -> tuple:
    end = member.index(b"\r\n\r\n")
    fields = headers(member[:end])
    block = member[end + 4 : end + 4 + int(fields["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    size = int(headers(block[:http_end])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = block[http_end + 4 :]
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    html = payload.decode() if with_html and fields["warc-type"] == "response" else None
    return fields["warc-page-id"], size, digest, fields["warc-type"], fields.get("warc-refers-to-page-id"), html


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
