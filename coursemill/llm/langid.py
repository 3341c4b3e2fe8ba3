"""Language identification by compression.

Every language gets a dictionary: some of its learned text as raw content for zstandard. A text belongs to
the language whose dictionary lets it be written in the fewest bytes. A classifier of this kind needs no
features; it is as good as the dictionary is like the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.operators.numbering import first_n

from .common import held_out, pieces, ship

#: Bound of what is learned: rows of each language, slices of each row and their characters, bytes of each dictionary.
SAMPLE_ROWS, SLICES, SLICE_CHARS, DICTIONARY_BYTES = 400, 4, 120, 32 << 10
SALTS = 64
#: Bytes that are compressed together, so that a long text goes on being compared with the dictionary
#: instead of with itself.
SEGMENT_BYTES = 2048
LEVEL = 6
#: A text whose second language is less than this share larger is too close to call.
NARROW = 0.02

_BETWEEN_WORDS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Letters in lower case, everything between words as one space."""
    return _BETWEEN_WORDS.sub(" ", text.lower()).strip().encode()


def learn_dictionaries(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of the rows that may be learned from.

    The sample is the ``SAMPLE_ROWS`` rows of each language whose id and text have the smallest hashes, so it
    does not depend on the order of the rows. Rows without text or language are not learned from.
    """
    rows = docs.filter(~held_out(F.col(id_column))).select(
        F.col(lang_column).cast("string").alias("_lang"),
        F.col(text_column).alias("_text"),
        F.xxhash64(F.lit("sample"), F.col(id_column), F.col(text_column)).alias("_order"),
    )
    rows = rows.filter("_lang is not null and _text rlike '\\\\p{L}'").select("_lang", "_order", _slices(F.col("_text")).alias("_text"))
    # Limited in each task, then in each of ``SALTS`` shares of a language, then in the language.
    order = [F.asc("_order"), F.asc("_text")]
    some = first_n(rows.withColumn("_salt", F.pmod("_order", F.lit(SALTS))), ["_lang", "_salt"], order, SAMPLE_ROWS, "_n")
    sample = first_n(some.drop("_n", "_salt"), ["_lang"], order, SAMPLE_ROWS, "_n")
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.select("_lang", "_n", "_text").collect()):
        found.setdefault(row["_lang"], []).append(plain(row["_text"]))
    return {lang: _joined(texts) for lang, texts in found.items()}


def _slices(text: Column) -> Column:
    """``SLICES`` slices of a text at equal distances from its beginning to its end; a short text as it is."""
    length = F.char_length(text)
    step = (length - SLICE_CHARS) / F.lit(max(1, SLICES - 1))
    parts = [F.substring(text, F.floor(step * i).cast("int") + 1, F.lit(SLICE_CHARS)) for i in range(SLICES)]
    return F.when(length <= SLICES * SLICE_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def _joined(texts: list[bytes]) -> bytes:
    """All texts of the sample in one dictionary: each gives its beginning, as long as the dictionary has room for all."""
    room = DICTIONARY_BYTES // len(texts)
    spare = DICTIONARY_BYTES - sum(min(len(t) + 1, room) for t in texts)
    kept = []
    for text in texts:
        more = min(spare, max(0, len(text) + 1 - room))
        spare -= more
        kept.append(text[: room + more - 1])
    return b" ".join(kept)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compress = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(
                    dictionaries[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                write_content_size=False,
            ).compress
            for lang in self.langs
        ]

    def sizes(self, text: bytes) -> list[int]:
        segments = [text[at : at + SEGMENT_BYTES] for at in range(0, len(text), SEGMENT_BYTES)]
        return [sum(len(compress(s)) for s in segments) for compress in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the decision is too close to call."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(plain(text))
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = 1 - sizes[best] / second if second else 0.0
        return self.langs[best], margin, margin < NARROW


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    ``score`` is the share of bytes that the best language saves against the second (0 to 1); ``rejected`` is
    true where it is below ``NARROW``, so that a caller who wants no guess can leave the language open. Texts
    that are null or have no letter get ``und``, 0 and rejected; so does every text when nothing was learned.
    Of equal sizes the first language in order of name is taken. Rows are judged one by one, so repeated rows
    and ids get repeated answers; other columns are ignored. Whole texts are compressed, in segments.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), held_out(F.col(id_column)))
    kind = rows.schema["_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for piece in (p for b in batches for p in pieces(b)):
            found = [classifier.predict(text) for text in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(2),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                names=["_id", "held_out", "lang_pred", "score", "rejected"],
            )

    judged = rows.mapInArrow(judge, f"_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return judged.withColumnRenamed("_id", id_column)
