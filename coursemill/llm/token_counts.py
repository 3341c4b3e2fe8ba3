"""Token counts by prefix dynamic programming.

A model's table of prefixes (``piece_models``) holds the last token of the encoding of every prefix, hence the
exact number of tokens of every prefix: one more than that of the prefix without its last token. Questions
about truncation and budgets are read off the table; no prefix is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship
from .piece_models import PieceModel, model


def token_counts(
    docs: DataFrame, serialized: bytes, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    Null and empty texts have 0 of either. Rows are counted one by one, so repeated rows and ids give repeated
    answers; other columns are ignored.
    """

    def count(codec: PieceModel, piece: pa.RecordBatch) -> list[pa.Array]:
        sizes = pc.fill_null(pc.binary_length(piece.column(1)), 0).cast(pa.int64())
        return [sizes, pa.array(codec.count_all(piece.column(1)), pa.int64())]

    return _by_row(docs, serialized, count, "n_bytes bigint, n_tokens bigint", id_column, text_column)


def prefix_counts(
    docs: DataFrame,
    serialized: bytes,
    lengths_column: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Tokens of the prefixes that each row asks for in ``lengths_column`` (an array of numbers of characters).

    ``n_tokens`` answers in the same order. A length beyond the text counts as the whole text, a negative or
    null one as 0; a null array gives an empty one.
    """

    def count(codec: PieceModel, piece: pa.RecordBatch) -> list[pa.Array]:
        answers = []
        for text, asked in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
            table = codec.counts_by_prefix(text)
            answers.append([int(table[min(max(n or 0, 0), len(table) - 1)]) for n in asked or []])
        return [pa.array(answers, pa.list_(pa.int64()))]

    return _by_row(docs, serialized, count, "n_tokens array<bigint>", id_column, text_column, lengths_column)


def truncated(
    docs: DataFrame, serialized: bytes, budget: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The longest prefix of each text whose encoding has at most ``budget`` tokens, and its ``n_tokens``.

    A longer prefix can have fewer tokens than a shorter one, so the last fitting place of the table is taken.
    Null stays null, with 0 tokens.
    """

    def cut(codec: PieceModel, piece: pa.RecordBatch) -> list[pa.Array]:
        texts, counts = [], []
        for text in piece.column(1).to_pylist():
            table = codec.counts_by_prefix(text)
            at = int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0
            texts.append(text if text is None else text[:at])
            counts.append(int(table[at]))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64())]

    return _by_row(docs, serialized, cut, f"`{text_column}` string, n_tokens bigint", id_column, text_column)


def _by_row(docs, serialized, work, schema, id_column, text_column, *more) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *(F.col(c).alias("_more") for c in more)
    )
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(serialized)
        for piece in (p for b in batches for p in pieces(b)):
            codec.trim()
            columns = [piece.column(0), *work(codec, piece)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    found = rows.mapInArrow(run, f"_id {kind}, {schema}")
    return found.withColumnRenamed("_id", id_column)
