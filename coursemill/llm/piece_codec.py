"""SentencePiece encoding and decoding of a table of texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, pieces, release, ship, text_bytes
from .piece_models import model

#: Bytes of text that are encoded at once: tables of units and ids take many times as much.
PIECE = 1 << 20


def encode(
    docs: DataFrame, serialized: bytes, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id and ``ids``, an array of integers; ``serialized`` is a model file's bytes.

    Null and empty texts have no ids. Begin and end marks are not added, and their spellings inside a text are
    ordinary characters. Rows are encoded one by one, so repeated rows and ids give repeated answers; other
    columns are ignored. Characters the model has no piece for become bytes where the model has them, else
    the unknown id.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("pieces")
        codec = model(serialized)
        for piece in (p for b in batches for p in pieces(b, limit=PIECE)):
            codec.trim()
            release()
            ids, places = codec.encode_all(piece.column(1))
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["_id", "ids"])

    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_column)


def decode(
    coded: DataFrame, serialized: bytes, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """One row per row of ``coded``: id and ``text``. Null and empty arrays give the empty text.

    What ``encode`` made of a text comes back as that text, but for the sign U+2581, which stands for a blank
    in such models and comes back as one. Begin and end marks write nothing, bytes that are no UTF-8 become
    replacement signs, an unknown id the model's sign for it. Ids that the model does not have are an error.
    """
    ship(coded.sparkSession)
    rows = coded.select(F.col(id_column).alias("_id"), F.col(ids_column).alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(serialized)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            data, places = codec.decode_all(ids.astype(np.int64), np.r_[0, np.cumsum(lengths)].astype(np.int64))
            raw, at = data.tobytes(), places.tolist()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_column)


def round_trip(
    docs: DataFrame, serialized: bytes, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every text and decode the ids again: id, ``n_tokens``, ``ids_crc32``, ``round_trip``.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian 32-bit integers, ``round_trip`` whether the
    decoded text is the one that was encoded (null as empty). Nulls, ids and columns as for ``encode``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(serialized)
        for piece in (p for b in batches for p in pieces(b)):
            codec.trim()
            release()
            ids, places = codec.encode_all(piece.column(1))
            raw, at = ids.astype("<i4").tobytes(), (places * 4).tolist()
            wrote, began = codec.decode_all(ids, places)
            data, offsets = text_bytes(piece.column(1))
            # Both sides are UTF-8, so texts are equal where their bytes are.
            left, right = wrote.tobytes(), data.tobytes()
            bounds = zip(began.tolist(), began[1:].tolist(), offsets.tolist(), offsets[1:].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(np.diff(places), pa.int64()),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                    pa.array([left[a:b] == right[c:d] for a, b, c, d in bounds], pa.bool_()),
                ],
                names=["_id", "n_tokens", "ids_crc32", "round_trip"],
            )

    schema = f"_id {kind}, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_column)
