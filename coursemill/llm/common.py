"""Helpers the text operators share: record batches as bytes, words and their hashes, files."""

from __future__ import annotations

import ctypes
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import coursemill
from coursemill.session import ADAPTIVE, apply_settings
from coursemill.store import shared_root

#: Bytes of text that are worked on at once inside a task (one text at least).
CHUNK_BYTES = 4 << 20

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they run.

    The sources go to the shared folder as a zip file that Spark hands out. Every operator that runs Python in
    tasks calls this first, so nothing has to be installed on the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = Path(coursemill.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent).as_posix())
    folder = join_path(shared_root(spark), "sources")
    make_folder(folder)
    uri = join_path(folder, "coursemill.zip")
    system, path = filesystem(uri)
    with system.open_output_stream(path) as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    apply_settings(spark, ADAPTIVE)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def pieces(batch: pa.RecordBatch, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` have at most ``limit`` bytes together, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give the memory of what was freed back to the system.

    A worker lives on from task to task and stage to stage; what its allocators keep is lost to the executor's other
    workers.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(_process(), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


@cache
def _process() -> ctypes.CDLL:
    return ctypes.CDLL(None)


_remembered: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """A dictionary that a worker keeps from task to task under this name."""
    return _remembered.setdefault(name, {})


def keep_only(name: str) -> None:
    """Forget what other operators' tasks have left in this worker, and give its memory back."""
    for other, kept in _remembered.items():
        if other != name:
            kept.clear()
    release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row and the n + 1 places where they begin and end; null counts as empty."""
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = whole.buffers()
    offsets = np.frombuffer(places, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts`` and have ``counts`` numbers, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, _kept: dict[int, tuple[np.ndarray, np.ndarray]] = remembered("powers")) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the hash's base and of its inverse modulo 2**64."""
    if n > max(_kept, default=0):
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_RATIO, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _kept.clear()
        _kept[size] = (both[0], both[1])
    forth, back = next(iter(_kept.values()))
    return forth[:n], back[:n]


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41 : 0x5B] = np.arange(0x61, 0x7B)
    return table


#: Byte of a word in lower case (A-Z only), 0 for bytes between words.
WORD_BYTES = _word_bytes()


@dataclass
class Words:
    """Words of several texts, one after the other."""

    low: np.ndarray  # bytes in lower case, 0 between words
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n + 1: number of the first word of each text

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[0-9a-z\\x80-\\xff]+`` of every text after lower-casing A-Z. None crosses two texts."""
    low = WORD_BYTES[data]
    inside = low != 0
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    forth, back = powers(len(data) + 1)
    if len(starts):
        sums = np.add.reduceat(low * forth[: len(data)], starts)
        hashes = mix(sums * back[starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(low, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words (on the last axis), by the place of the first; those across texts too."""
    n = max(0, hashes.shape[-1] - k + 1)
    total = np.zeros((*hashes.shape[:-1], n), np.uint64)
    for j, factor in enumerate(powers(k + 1)[0][1:]):
        total += hashes[..., j : j + n] * factor
    return mix(total + np.uint64(k))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder: a URI that Arrow knows, or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)
