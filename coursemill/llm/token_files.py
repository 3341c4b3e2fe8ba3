"""Token-id files: flat unsigned ids with 64-bit document offsets, one shard per range of documents.

A folder holds, for every shard,

    part-00003-<attempt>.ids      all ids of the shard's documents, little-endian unsigned 16 or 32 bits
    part-00003-<attempt>.offsets  n + 1 little-endian unsigned 64-bit places inside the shard, counted in ids
    part-00003-<attempt>.docs     the n document ids, an Arrow file

and the table ``manifest`` with one row per shard: its number, file name, documents, ids, bytes of an id, and
``base``, the number of ids in all shards before it. Ids take 16 bits where the whole vocabulary fits. Only files that the manifest names count: a task that was lost or
ran twice leaves files that nobody reads.
"""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.store import Store

from .chunks import dictionary
from .common import filesystem, join_path, make_folder, pieces, ranges, ship, text_bytes

#: Words whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 300_000


_BLANK, _SIGN, _LETTER, _AFTER_C3 = (np.zeros(256, bool) for _ in range(4))
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SIGN[[*b".,;:!?$&*|"]] = True
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_AFTER_C3[[*range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first part of each text, n + 1 places; number of every part; the different parts) of several texts.

    Parts are what the tokenizer never joins: it cuts at white space, and between a letter or digit and signs. The
    latter is done here where white space follows, so that there are few different parts. A text with the marker
    of a special token, which is told by its small letters, is cut at white space alone and keeps its capitals.
    """
    data, offsets = text_bytes(texts)
    n = len(data)
    marked = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
    plain = np.repeat(~marked, np.diff(offsets))
    low = np.where(plain, _LOWER[data], data)
    blank, sign = _BLANK[low], _SIGN[low]
    starts_text, ends_text = np.zeros(n, bool), np.zeros(n, bool)
    some = np.diff(offsets) > 0
    starts_text[offsets[:-1][some]] = True
    ends_text[offsets[1:][some] - 1] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | starts_text[1:]
    finishes = ~blank
    finishes[:-1] &= blank[1:] | ends_text[:-1]
    # Runs of signs after a letter and before white space of the same text.
    first = np.flatnonzero(sign[1:] & ~sign[:-1] & ~starts_text[1:] & plain[1:]) + 1
    last = np.flatnonzero(sign[:-1] & ~ends_text[:-1] & blank[1:] & plain[:-1])
    if len(first) and len(last):
        two_back = np.where(first > 1, low[first - 2], 0)
        letter = _LETTER[low[first - 1]] | (_AFTER_C3[low[first - 1]] & (two_back == 0xC3) & ~starts_text[first - 1])
        stop = last[np.minimum(np.searchsorted(last, first), len(last) - 1)]
        whole = np.r_[0, np.cumsum(sign)]
        cut = first[letter & (stop >= first) & (whole[np.maximum(stop, first) + 1] - whole[first] == np.maximum(stop, first) + 1 - first)]
        begins[cut] = True
        finishes[cut - 1] = True
    starts = np.flatnonzero(begins)
    number, different = dictionary(low, starts, np.flatnonzero(finishes) + 1)
    return np.searchsorted(starts, offsets), number, different


class WordEncoder:
    """Ids of whole texts as unsigned 32-bit integers, from the ids of their words.

    For tokenizers that lower letters, cut at white space, which they drop, and between letters and signs:
    a text's ids are then those of its parts, one after the other. Each different part goes through the
    library once while it is remembered; all else, markers of special tokens included, is left to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.largest_id = max(self.library.get_vocab().values())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Put the ids of all these words where ``encode`` looks them up."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        asked = []
        for word in words:
            found = self.old.get(word)
            if found is None:
                asked.append(word)
            else:
                self.young[word] = found
        for at in range(0, len(asked), 20_000):
            some = asked[at : at + 20_000]
            found = self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.young.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, found))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, places = self.encode_all(pa.array(texts, pa.string()), 0)
        return [ids[a : b - 1].tobytes() for a, b in zip(places, places[1:])]

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ``end_id`` after each; n + 1 places where those of each begin)."""
        first, number, different = parts(texts)
        words = [w.encode() for w in different.to_numpy(zero_copy_only=False).tolist()]
        if len(self.young) > REMEMBERED:
            self.learn(words)
        else:
            self.learn(filterfalse(self.young.__contains__, words))
        coded = [self.young[w] for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, starts, counts = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(lengths) - lengths, lengths[number]
        places = np.r_[0, np.cumsum(counts)][first] + np.arange(len(first))
        whole = np.full(places[-1], end_id, "<u4")
        inside = np.ones(len(whole), bool)
        inside[places[1:] - 1] = False
        whole[inside] = ids[ranges(starts[number], counts)]
        return whole, places


def encoder(path: str, _kept: dict[str, WordEncoder] = {}) -> WordEncoder:
    if path not in _kept:
        _kept[path] = WordEncoder(path)
    return _kept[path]


MANIFEST = "shard int, file string, n_docs long, n_ids long, id_bytes int"


def write_token_files(
    docs: DataFrame,
    folder: str,
    store: Store,
    tokenizer_path: str,
    end_id: int,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id``, write the shards below ``folder``; returns the manifest.

    Documents are in ascending order of id, nulls first, those with equal ids in the order of their texts'
    hashes and bytes. The ranges are cut on (id, hash), so that even an id with a third of all rows is spread.
    Null texts count as empty and have the end id only. Other columns are ignored. An empty table gives an
    empty manifest. The manifest is written before its bases are added up, so the shards are made once.
    """
    ship(docs.sparkSession)
    make_folder(folder)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    rows = rows.withColumn("_order", F.xxhash64("_text"))
    id_bytes = 2 if max(encoder(tokenizer_path).largest_id, end_id) < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lengths, keys = TaskContext.get().partitionId(), [np.zeros(1, np.uint64)], []
        name = f"part-{shard:05d}-{uuid.uuid4().hex}"
        system, path = filesystem(join_path(folder, name))
        words = encoder(tokenizer_path)
        with system.open_output_stream(f"{path}.ids") as out:
            for batch in batches:
                keys.append(batch.column(0))
                for piece in pieces(batch):
                    ids, own = words.encode_all(piece.column(1), end_id)
                    out.write(ids.astype(f"<u{id_bytes}").tobytes())
                    lengths.append(np.diff(own).astype(np.uint64))
        if not keys:
            system.delete_file(f"{path}.ids")
            return
        places = np.cumsum(np.concatenate(lengths), dtype="<u8")
        with system.open_output_stream(f"{path}.offsets") as out:
            out.write(places.tobytes())
        keys = pa.table({"id": pa.chunked_array(keys)})
        with system.open_output_stream(f"{path}.docs") as out, pa.ipc.new_file(out, keys.schema) as file:
            file.write_table(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([name]),
                pa.array([keys.num_rows], pa.int64()),
                pa.array([int(places[-1])], pa.int64()),
                pa.array([id_bytes], pa.int32()),
            ],
            names=["shard", "file", "n_docs", "n_ids", "id_bytes"],
        )

    ordered = rows.repartitionByRange(shards, "_id", "_order").sortWithinPartitions("_id", "_order", "_text")
    made = store.keep(ordered.select("_id", "_text").mapInArrow(write, MANIFEST), "token-shards")
    # One row per shard: its base is the running sum of the shards before it.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    manifest.write.parquet(join_path(folder, "manifest"))
    return docs.sparkSession.read.schema(manifest.schema).parquet(join_path(folder, "manifest"))


def mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where it is local, else read in full."""
    system, path = filesystem(uri)
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_stream(path) as file:
        return np.frombuffer(file.read(), kind)


def read_token_files(folder: str, manifest: DataFrame, tasks: int, id_type: str = "bigint") -> DataFrame:
    """One row per document, from the files: doc_id, ``start`` (ids before it), ``n_tokens``, ``ids`` as 32-bit integers.

    Every shard is mapped by one of ``tasks`` tasks, a few megabytes of ids at a time.
    """

    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                at = join_path(folder, shard["file"])
                places = mapped(f"{at}.offsets", "<u8").astype(np.int64)
                ids = mapped(f"{at}.ids", f"<u{shard['id_bytes']}")
                system, path = filesystem(f"{at}.docs")
                with system.open_input_file(path) as file:
                    keys = pa.ipc.open_file(file).read_all().column("id").combine_chunks()
                step = max(1, len(keys) * (4 << 20) // max(1, int(places[-1]) * 4))
                for k in range(0, len(keys), step):
                    own = places[k : k + step + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys[k : k + step],
                            pa.array(own[:-1] + shard["base"], pa.int64()),
                            pa.array(np.diff(own), pa.int64()),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(own, own[1:])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    shards = manifest.select("file", "base", "id_bytes").repartition(tasks, "file")
    return shards.mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")

