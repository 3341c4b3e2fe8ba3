"""Documents in written chunks of bounded size, for operators that pass over the texts more than once.

A chunk keeps its number and its rows from one pass to the next, whatever Spark does with the partitions: what
one pass found out about a chunk finds its way back to it by the number. Chunks are as large as a Python worker
handles at once, so tables about them have few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from coursemill.store import Store

from .common import pieces, ship

#: Bytes of text in a chunk (one text at least).
CHUNK_TEXT = 4 << 20
CHUNKS = "chunk bigint, size bigint, packed binary"


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(packed: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(packed) as stream:
        return stream.read_next_batch()


def write_chunks(rows: DataFrame, store: Store, text: int, limit: int = CHUNK_TEXT) -> DataFrame:
    """``rows`` as a written table (``CHUNKS``): a number, the bytes of text and the packed rows; ``text`` is the place of the text column.

    Numbers are made of the partition and a count, so they are distinct; the table is written once, so they last.
    An empty table gives no chunk.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            columns = [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_rows(whole)])]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "size", "packed"])

        for piece in (p for b in batches for p in pieces(b, text, limit)):
            own = int(pc.sum(pc.binary_length(piece.column(text))).as_py() or 0)
            if waiting and size + own > limit:
                yield closed()
                number, waiting, size = number + 1, [], 0
            waiting.append(piece)
            size += own
        if waiting:
            yield closed()

    return store.keep(rows.mapInArrow(run, CHUNKS), "chunks")


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the different words, and those words as strings, in order of first occurrence.

    Words are told apart by their bytes, in Arrow's hash table.
    """
    lengths = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=places[1:])
    # Words do not overlap and are in order, so their bytes are those between a start and the next end.
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    packed = data[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(packed))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
