"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-word hashes of each sliding window of w such hashes. Any
k + w - 1 words that a document shares with a benchmark item hold one whole window, so both select the
same fingerprint there: no shared span of that length can be missed. A fingerprint met in a document is
then extended to the benchmark's windows around it and confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.store import Store

from .common import Words, grams, pieces, ship, text_bytes, words_of

#: Bytes of benchmark text that one pass over the documents holds in memory. More text makes more passes.
BLOCK_BYTES = 2 << 20


def gram_and_window(length: int) -> tuple[int, int]:
    """k and w for shared spans of ``length`` words: k + w - 1 is the length."""
    k = (length + 1) // 2
    return k, length - k + 1


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def selected(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the smallest hash of some window of ``w``; of a tie, all of them."""
    if len(hashes) <= w:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    least = sliding(hashes, w, np.minimum)
    none = np.zeros(w - 1, hashes.dtype)
    return np.flatnonzero(sliding(np.concatenate([none, least, none]), w, np.maximum) == hashes)


@dataclass
class Windows:
    """The benchmark's windows of one length."""

    length: int
    fingerprints: np.ndarray  # sorted
    hashes: np.ndarray  # of whole windows, sorted
    items: dict[bytes, list[int]]  # by the window's words


def _window_words(words: Words, at: int, length: int) -> bytes:
    return b" ".join(words.low[words.starts[i] : words.ends[i]].tobytes() for i in range(at, at + length))


def benchmark_windows(texts: list[str | None], length: int) -> list[Windows]:
    """Windows of all items: ``length`` words, or all words of an item that has fewer, but not none."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = words_of(data, offsets)
    counts = np.diff(words.first)
    found = []
    for n in sorted({min(int(c), length) for c in counts if c}):
        k, w = gram_and_window(n)
        marks, whole, items = [], [], {}
        for item in np.flatnonzero(np.minimum(counts, length) == n):
            a, b = words.first[item], words.first[item + 1]
            small = grams(words.hashes[a:b], k)
            marks.append(small[selected(small, w)])
            whole.append(grams(words.hashes[a:b], n))
            for at in range(a, b - n + 1):
                own = items.setdefault(_window_words(words, at, n), [])
                if not own or own[-1] != item:
                    own.append(int(item))
        found.append(Windows(n, np.unique(np.concatenate(marks)), np.unique(np.concatenate(whole)), items))
    return found


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def hits(words: Words, windows: list[Windows]) -> Iterator[tuple[int, int, list[int]]]:
    """(first word, number of words, items) of every benchmark window in the texts."""
    owner = words.text
    for known in windows:
        k, w = gram_and_window(known.length)
        small = grams(words.hashes, k)
        if not len(small):
            continue
        # A k-gram across two texts is never the smallest, so it can only add places to the selection.
        small[owner[: len(small)] != owner[k - 1 :]] = np.iinfo(np.uint64).max
        places = selected(small, w)
        places = places[_among(small[places], known.fingerprints)]
        if not len(places):
            continue
        starts = np.unique((places[:, None] - np.arange(w)).ravel())
        starts = starts[(starts >= 0) & (starts + known.length <= len(words.hashes))]
        starts = starts[owner[starts] == owner[starts + known.length - 1]]
        if not len(starts):
            continue
        around = words.hashes[starts[:, None] + np.arange(known.length)]
        for at in starts[_among(grams(around, known.length)[:, 0], known.hashes)]:
            items = known.items.get(_window_words(words, at, known.length))
            if items:
                yield int(at), known.length, items


def _blocks(items: DataFrame, limit: int) -> list[tuple[list, list]]:
    """Ids and texts of the benchmark in blocks of bounded size."""
    blocks, size = [([], [])], 0
    for row in items.toLocalIterator():
        n = len((row["_text"] or "").encode())
        if size and size + n > limit:
            blocks.append(([], []))
            size = 0
        blocks[-1][0].append(row["_id"])
        blocks[-1][1].append(row["_text"])
        size += n
    return blocks


def _runs(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of every run of covered words; runs end where texts end."""
    begins, finishes = covered.copy(), covered.copy()
    begins[1:] &= ~covered[:-1]
    finishes[:-1] &= ~covered[1:]
    cuts = first[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(covered))]
    begins[cuts] = covered[cuts]
    finishes[cuts - 1] = covered[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def _scan(block: Broadcast, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass: adds the hits of a block of the benchmark to the spans and items that the rows carry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, windows = block.value
        for piece in (p for b in batches for p in pieces(b)):
            words = words_of(*text_bytes(piece.column(1)))
            change = np.zeros(len(words.hashes) + 1, np.int64)
            named = [set(x) for x in piece.column(4).to_pylist()]
            for row, spans in enumerate(piece.column(3).to_pylist()):
                for span in spans:
                    change[words.first[row] + span["start"]] += 1
                    change[words.first[row] + span["stop"]] -= 1
            for at, length, items in hits(words, windows):
                change[at] += 1
                change[at + length] -= 1
                row = int(np.searchsorted(words.first, at, side="right")) - 1
                named[row].update(ids[i] for i in items)
            begins, finishes = _runs(np.cumsum(change)[:-1] > 0, words.first)
            bounds = np.searchsorted(begins, words.first)
            base = np.repeat(words.first[:-1], np.diff(bounds))
            runs = pa.StructArray.from_arrays(
                [pa.array(begins - base, pa.int64()), pa.array(finishes - base, pa.int64())], names=["start", "stop"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.nulls(piece.num_rows, pa.string()) if last else piece.column(1),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                    pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                    *piece.columns[5:],
                ],
                names=piece.schema.names,
            )

    return scan


def contamination(
    docs: DataFrame,
    items: DataFrame,
    store: Store,
    length: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``spans``, ``items``.

    ``spans`` are the maximal runs of hit words, as numbers of the first word and of the word after the last;
    ``items`` are the ids of the benchmark items with a window in the document, as sorted strings. The
    benchmark comes to the tasks in blocks of ``block_bytes``, one pass over the documents for each; between
    passes the rows are written with what was found so far. Nothing of the documents is shuffled.

    Null and empty texts have no words. A null item id counts as ''. Items that repeat are met all alike,
    and an id that stands for several items is listed once. Without items nothing is hit. Rows with equal
    ids are judged one by one. Other columns are ignored, or with ``carry`` kept beside the answers, as the
    structure ``row``, so that rows can be filtered without joining them.
    """
    spark = docs.sparkSession
    ship(spark)
    found = docs.select(
        F.col(id_column).alias("_id"),
        F.col(text_column).alias("_text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    schema = found.schema
    kept = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_id"), F.col(item_text).alias("_text")
    )
    blocks = _blocks(kept.filter("_text is not null"), block_bytes)
    for number, (ids, texts) in enumerate(blocks, 1):
        block = spark.sparkContext.broadcast((ids, benchmark_windows(texts, length)))
        found = found.mapInArrow(_scan(block, number == len(blocks)), schema)
        if number < len(blocks):
            found = store.keep(found, "contamination")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    carried = ["row"] if carry else []
    return found.select(F.col("_id").alias(id_column), "n_words", n_hit.alias("n_hit"), "spans", "items", *carried)
