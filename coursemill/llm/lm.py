"""Language-model scores of whole texts: add-one counts of words, and a causal self-attention model on subword ids.

Words are counted over all texts that may be learned from. Chunks deal out their different words, compressed, by
hash; where a word's entries meet they are added up, and each chunk gets back the counts of its own words. The words
met also give the counts of all subword ids in the corpus, from which the model's output tree is made. The network
is fitted where the chunks are, by learners whose changes are averaged in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.store import Store

from .attention import BLOCK, DIM, Adagrad, Model, Params, blocks, huffman, new_params, score, steps_over
from .chunks import dictionary, pack_rows, unpack_rows, write_chunks
from .common import ranges, ship, text_bytes

#: Bytes of text whose words meet in one task.
SHARE = 32 << 20
#: Steps that a fit takes at least, and blocks of a step, fewest and most: small corpora are passed over repeatedly.
STEPS, STEP_BLOCKS = 1_200, (128, 2_048)
RATE, SEED = 0.4, 11
#: Rounds of a pass by several learners, bytes of text of a learner in a round; learners of a round at most (they get
#: more text instead); parts in which what they found is averaged.
ROUNDS, LEARNER, LEARNERS, PARTS = 4, 8 << 20, 256, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def learned_from(doc_id: Column) -> Column:
    """False for rows held out: crc32 of the id as text leaves 2 when divided by 7. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text, n + 1 places; number of each word; the different words), in lower case (A-Z)."""
    data, offsets = text_bytes(texts)
    low = _LOWER[data]
    inside = ~_BLANK[low]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    number, different = dictionary(low, starts, np.flatnonzero(finishes) + 1)
    return np.searchsorted(starts, offsets), number, different


def _spread(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of every word, from its bytes."""
    data, offsets = text_bytes(words)
    raw, at = data.tobytes(), offsets.tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(words))
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _order(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of their buckets, and where each bucket begins (buckets + 1 places)."""
    bucket = _spread(words, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _deal(buckets: int):
    """The different words of each chunk with their counts in texts that may be learned from, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, packed in ((c, p) for b in batches for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            rows = unpack_rows(packed)
            first, number, words = words_in(rows.column(1))
            own = np.repeat(rows.column(2).to_numpy(zero_copy_only=False), np.diff(first))
            counts = np.bincount(number[own], minlength=len(words))
            order, bounds = _order(words, buckets)
            words, counts = words.take(pa.array(order)), counts[order]
            some = np.flatnonzero(np.diff(bounds))
            parts = [
                pack_rows(pa.RecordBatch.from_arrays([words[a:b], pa.array(counts[a:b])], names=["word", "n"]))
                for a, b in zip(bounds[some], bounds[some + 1])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(parts, pa.binary())],
                names=["bucket", "chunk", "packed"],
            )

    return run


class Pieces:
    """Subword ids of words, by the library of the model file."""

    def __init__(self, serialized: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.begin, self.end, self.size = self.library.bos_id(), self.library.eos_id(), self.library.get_piece_size()

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, n + 1 places where they begin)."""
        coded = self.library.encode(words.to_numpy(zero_copy_only=False).tolist(), num_threads=1) if len(words) else []
        places = np.zeros(len(coded) + 1, np.int64)
        np.cumsum([len(x) for x in coded], out=places[1:])
        return np.fromiter(chain.from_iterable(coded), np.int64, places[-1]), places


def _meet(serialized: bytes):
    """Counts of a bucket's words over all chunks, in the order of each chunk; a row without chunk sums up the bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack_rows(x) for x in table.column("packed").to_pylist()]
        coded = pa.chunked_array([p.column(0) for p in parts]).combine_chunks().dictionary_encode()
        number = coded.indices.to_numpy()
        total = np.bincount(number, np.concatenate([p.column(1).to_numpy() for p in parts])).astype(np.int64)
        press, places = zstandard.ZstdCompressor(level=1), np.cumsum([0, *(p.num_rows for p in parts)])
        counts = [press.compress(total[number[a:b]].astype("<i8").tobytes()) for a, b in zip(places, places[1:])]
        learned = np.flatnonzero(total)
        pieces = Pieces(serialized)
        ids, at = pieces.of(coded.dictionary.take(pa.array(learned)))
        of_ids = np.bincount(ids, np.repeat(total[learned], np.diff(at)), minlength=pieces.size).astype(np.int64)
        some = np.flatnonzero(of_ids)
        none = [None] * len(counts)
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()] * (len(counts) + 1), pa.int32()),
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "counts": pa.array([*counts, None], pa.binary()),
                "n_words": pa.array([*none, int(total.sum())], pa.int64()),
                "n_different": pa.array([*none, len(learned)], pa.int64()),
                "ids": pa.array([*none, some.tolist()], pa.list_(pa.int32())),
                "id_counts": pa.array([*none, of_ids[some].tolist()], pa.list_(pa.int64())),
            }
        )

    return run


_MET = "bucket int, chunk bigint, counts binary, n_words bigint, n_different bigint, ids array<int>, id_counts array<bigint>"


def _sequences(first: np.ndarray, number: np.ndarray, words: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text between begin and end, one after the other, and the number of ids of each text with its end."""
    ids, at = pieces.of(words)
    counts = np.diff(at)[number]
    running = np.r_[0, np.cumsum(counts)]
    of_text = running[first[1:]] - running[first[:-1]]
    whole = np.full(of_text.sum() + 2 * len(of_text), pieces.end, np.int64)
    begins = np.cumsum(of_text + 2) - of_text - 2
    whole[begins] = pieces.begin
    whole[ranges(begins + 1, of_text)] = ids[ranges(at[number], counts)]
    return whole, of_text + 1


def _flat(params: Params) -> np.ndarray:
    """All parameters as rows of ``DIM``."""
    return np.concatenate([v.reshape(-1, DIM) for v in params.values()])


def _views(flat: np.ndarray, like: dict[str, tuple[int, ...]]) -> Params:
    """The parameters of these shapes that lie in ``flat``."""
    found, at = {}, 0
    for name, shape in like.items():
        rows = int(np.prod(shape)) // DIM
        found[name] = flat[at : at + rows].reshape(shape)
        at += rows
    return found


def _pack_changes(rows: np.ndarray, changes: np.ndarray) -> bytes:
    """Row numbers and their changes, the upper half of each float."""
    half = ((np.ascontiguousarray(changes, "<f4").view("<u4") + np.uint32(1 << 15)) >> 16).astype("<u2")
    return zstandard.ZstdCompressor(level=1).compress(rows.astype("<i4").tobytes() + half.tobytes())


def _unpack_changes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // (4 + 2 * 2 * DIM)
    half = np.frombuffer(raw, "<u2", offset=4 * n).reshape(n, 2 * DIM)
    return np.frombuffer(raw, "<i4", n), (half.astype("<u4") << 16).view("<f4")


def _learn(sent, serialized: bytes, step: int, passes: int, first_rate: float, fall: float):
    """What learning from a task's chunks changes in the network, by part of its rows.

    Every target of every text that may be learned from is learned ``passes`` times. The rate falls so much with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(serialized)
        paths, flat, had, like = sent.value
        own, own_had = flat.copy(), had.copy()
        params, seen = _views(own, like), 0
        model, optimizer = Model(params, paths), Adagrad(params, _views(own_had, like))

        def rate(n: int) -> float:
            nonlocal seen
            now = first_rate - fall * seen
            seen += n
            return now

        def texts() -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
            for chunk, packed in ((r["chunk"], r["packed"]) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                rows = unpack_rows(packed)
                rows = rows.filter(pc.and_(rows.column(2), pc.is_valid(rows.column(1))))
                if rows.num_rows:
                    yield chunk, blocks(*_sequences(*words_in(rows.column(1)), pieces))

        whole = texts() if passes == 1 else list(texts())  # several passes are over few texts
        for n in range(passes):
            for chunk, one in whole:
                steps_over(model, optimizer, one, step, np.random.default_rng((SEED, n, chunk)), rate)
        changed = np.flatnonzero((own_had != had).any(axis=1))
        bounds = np.searchsorted(changed, np.arange(PARTS + 1) * len(flat) // PARTS)
        some = np.flatnonzero(np.diff(bounds))
        changes = np.concatenate([own[changed] - flat[changed], own_had[changed] - had[changed]], axis=1)
        found = [_pack_changes(changed[a:b], changes[a:b]) for a, b in zip(bounds[some], bounds[some + 1])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found, pa.binary())], names=["part", "packed"])

    return run


def _average(key: tuple, table: pa.Table) -> pa.Table:
    """The mean change of each row over the learners that changed it."""
    found = [_unpack_changes(x) for x in sorted(table.column("packed").to_pylist())]
    rows = np.unique(np.concatenate([r for r, _ in found]))
    total, learners = np.zeros((len(rows), 2 * DIM), np.float32), np.zeros((len(rows), 1), np.float32)
    for own, changes in found:
        at = np.searchsorted(rows, own)
        total[at] += changes
        learners[at] += 1
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([_pack_changes(rows, total / learners)], pa.binary())})


def fit(chunks: DataFrame, size: int, counts: np.ndarray, serialized: bytes) -> Model:
    """Fit the network on all texts that may be learned from, of chunks with ``size`` bytes of text together.

    The output tree has the counts of the whole corpus. Learners take the chunks that Spark gives to one task, in
    rounds of falling rates: each starts from the same network, learns from every target of its texts, and then the
    changes are averaged. Small corpora have one learner and one round, and as many passes as give ``STEPS`` steps.
    The same chunks in the same tasks give the same network.
    """
    spark, start = chunks.sparkSession, new_params(len(counts), SEED)
    paths, like, flat = huffman(counts), {k: v.shape for k, v in start.items()}, _flat(start)
    had, targets = np.full_like(flat, 1e-8), max(1, int(counts.sum()))
    step = int(np.clip(targets // (STEPS * BLOCK), *STEP_BLOCKS))
    passes = -(-STEPS * step * BLOCK // targets)
    learners = min(LEARNERS, -(-size // (ROUNDS * LEARNER)))
    if passes > 1 or learners < 2:
        learners, rounds = 1, 1
    else:
        rounds = ROUNDS
    turn = F.expr(f"((chunk >> 32) + (chunk & {(1 << 32) - 1})) % {rounds}")  # the partition's number and that in the partition
    for k in range(rounds if counts.any() else 0):
        sent = spark.sparkContext.broadcast((paths, flat, had, like))  # of the size of the model file's vocabulary
        rate = (RATE, RATE / (passes * targets)) if rounds == 1 else (RATE * (1 - (k + 0.5) / rounds), 0.0)
        learn = _learn(sent, serialized, step, passes, *rate)
        mine = chunks.filter(turn == k).coalesce(learners).mapInArrow(learn, "part int, packed binary")
        for row in mine.groupBy("part").applyInArrow(_average, "part int, packed binary").collect():
            rows, changes = _unpack_changes(bytes(row["packed"]))
            flat[rows] += changes[:, :DIM]
            had[rows] += changes[:, DIM:]
        sent.unpersist()
    return Model(_views(flat, like), paths)


def _score(sent, serialized: bytes, buckets: int, total: int, different: int, ends: int):
    """Scores of a chunk's texts from the counts of its words and the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, inflate = Pieces(serialized), zstandard.ZstdDecompressor()
        floor = np.log10(total + different + 1)
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            rows = unpack_rows(row["packed"])
            first, number, words = words_in(rows.column(1))
            order, bounds = _order(words, buckets)
            counts = np.zeros(len(words), np.int64)
            for one in row["met"] or []:
                at = order[bounds[one["bucket"]] : bounds[one["bucket"] + 1]]
                counts[at] = np.frombuffer(inflate.decompress(one["counts"]), "<i8")

            def per_text(of_word: np.ndarray) -> np.ndarray:
                running = np.r_[0, np.cumsum(of_word[number])]
                return running[first[1:]] - running[first[:-1]]

            n_words = np.diff(first)
            known = per_text((counts > 0).astype(np.int64)) + (ends > 0)
            base = per_text(np.log10(counts + 1)) + np.log10(ends + 1) - (n_words + 1) * floor
            ids, lengths = _sequences(first, number, words, pieces)
            targets = np.ones(len(ids), bool)
            targets[np.cumsum(lengths + 1) - lengths - 1] = False
            inputs = np.roll(targets, -1)
            found = score(sent.value, ids[inputs], ids[targets], lengths)
            found = np.add.reduceat(found, np.cumsum(lengths) - lengths) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pc.invert(rows.column(2)),
                    pa.array(n_words + 1, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(np.full(len(found), total), pa.int64()),
                    pa.array(base),
                    pa.array(found),
                ],
                names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def lm_scores(
    docs: DataFrame, serialized: bytes, store: Store, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words between white space, in lower case (A-Z), and one end of each text. ``base_score`` is the
    logarithm (base 10) of the text's probability by add-one counts of tokens, ``score`` that of the attention model
    for the subword ids of the same words and an end. Counts, the network's output tree and its weights (``fit``) come
    from all rows that are not held out; null texts have counted ends, but the weights are not fitted on them.

    Null texts are empty: an end alone. Rows are scored one by one, so repeated rows and ids get repeated answers and
    count repeatedly; other columns are ignored. With nothing to learn from, every token is unknown and the network
    gives all subword ids nearly equal odds. An empty table gives an empty result. ``serialized`` are the bytes of a
    SentencePiece model file.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), learned_from(F.col(id_column)).alias("_learn")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    chunks = write_chunks(rows, store, text=1)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1)
    known = chunks.select("chunk", "packed")
    dealt = known.mapInArrow(_deal(buckets), "bucket int, chunk bigint, packed binary")
    met = store.keep(dealt.groupBy("bucket").applyInArrow(_meet(serialized), _MET), "words")

    ends = rows.filter("_learn").count()
    words, different = met.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_different"), F.lit(0))).first()
    # One row per id of the model file.
    pairs = met.select(F.explode(F.arrays_zip("ids", "id_counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.id_counts"))
    pieces = Pieces(serialized)
    counts = np.zeros(pieces.size, np.int64)
    for i, count in pairs.collect():
        counts[i] = count
    counts[pieces.end] += ends
    sent = spark.sparkContext.broadcast(fit(known, size, counts, serialized))  # of the size of the model file's vocabulary

    back = met.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("met"))
    scored = known.join(back, "chunk", "left").mapInArrow(
        _score(sent, serialized, buckets, words + ends, different + (ends > 0), ends),
        f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumnRenamed("_id", id_column)
