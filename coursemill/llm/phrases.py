"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over a chunk's words give the fingerprint of every phrase in one subtraction. Of each chunk the
different fingerprints, with their counts, are dealt out by value; where they meet they are added up, and every
chunk gets back one bit for each: whether it is frequent in all. The place in the chunk's list is the pointer to the
occurrences. First this is done for phrases of one and two words, then for the longer ones, of which only those are
counted whose parts were all frequent. At the end chunks write out the words of their frequent phrases, again dealt
by fingerprint, and counts are added up by words: phrases that share a fingerprint part there, so counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.operators.numbering import first_n
from coursemill.store import Store

from .chunks import dictionary, pack_rows, unpack_rows, write_chunks
from .common import mix, powers, release, ship, text_bytes

LONGEST, LEAST, BEST, COVERED = 5, 100, 2000, 100
#: Orders (words of a phrase) that are counted together.
ROUNDS = ((1, 2), (3, 4, 5))
#: Bytes of text whose fingerprints meet in one task.
SHARE = 16 << 20
UNKNOWN_LANG = "und"
#: floor(1000 * a * n / (l * r)) in decimals of 38 digits.
_WIDE = "cast({} as decimal(16, 0))".format
SCORE = f"cast(cast(1000 as decimal(4, 0)) * {_WIDE('a')} * {_WIDE('n')} div ({_WIDE('l')} * {_WIDE('r')}) as bigint)"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Kind of a byte: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass
class Phrases:
    """The words of a chunk, joined by one space each, ready for fingerprints of all their runs."""

    joined: np.ndarray  # bytes of the words, a space after each
    begins: np.ndarray  # n + 1 places in ``joined``
    piece: np.ndarray  # number of the piece of each word
    lang: np.ndarray  # number of the language of each word
    langs: list[str]
    number: np.ndarray  # number of each word among the different ones
    sums: np.ndarray  # prefix polynomials
    salt: np.ndarray  # by language

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every run of ``n`` words inside a piece."""
        count = max(0, len(self.piece) - n + 1)
        first = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :][:count])
        start, stop = self.begins[first], self.begins[first + n] - 1
        back = powers(len(self.joined) + 1)[1]
        value = (self.sums[stop] - self.sums[start]) * back[start] + (stop - start).astype(np.uint64)
        return first, mix(value + self.salt[self.lang[first]])


def phrases_of(langs: pa.Array, texts: pa.Array) -> Phrases:
    """Words of the texts in lower case (A-Z). No piece crosses two texts."""
    data, offsets = text_bytes(texts)
    low = _LOWER[data]
    kind = _KIND[low]
    inside = kind == 0
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    lengths = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=places[1:])
    joined = np.full(places[-1], 0x20, np.uint8)
    words = np.ones(len(joined), bool)
    words[places[1:] - 1] = False
    joined[words] = low[inside]
    # In place: an array of 8 bytes a character is the largest a chunk needs.
    sums = np.zeros(len(joined) + 1, np.uint64)
    sums[1:] = joined
    sums[1:] += np.uint64(1)
    sums[1:] *= powers(len(joined) + 1)[0][:-1]
    np.cumsum(sums[1:], out=sums[1:])
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return Phrases(
        joined,
        places,
        np.searchsorted(np.flatnonzero(kind == 2), starts) + text,  # grows with both, so it is equal where both are
        coded.indices.to_numpy(zero_copy_only=False)[text],
        names,
        dictionary(low, starts, ends)[0],
        sums,
        np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64),
    )


def _different(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs; sorts in place."""
    values.sort()
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def _bounds(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of fingerprints begins and ends among ordered values."""
    width = (1 << 64) // buckets
    return np.r_[np.searchsorted(values, np.arange(buckets, dtype=np.uint64) * np.uint64(width)), len(values)]


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of ordered values and counts, as planes of equal bytes, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = np.array([len(values)], "<i8").tobytes() + steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    steps = np.ascontiguousarray(raw[8 : 8 + 8 * n].reshape(8, n).T).reshape(-1).view("<u8")
    counts = np.ascontiguousarray(raw[8 + 8 * n :].reshape(4, n).T).reshape(-1).view("<u4")
    return np.cumsum(steps, dtype=np.uint64), counts


def _frequent(values: np.ndarray, buckets: int, bits: list[dict] | None) -> np.ndarray:
    """Those of a chunk's different fingerprints that came back as frequent."""
    bounds, kept = _bounds(values, buckets), np.zeros(len(values), bool)
    for one in bits or []:
        a, b = bounds[one["bucket"]], bounds[one["bucket"] + 1]
        kept[a:b] = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=b - a)
    return values[kept]


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _candidates(found: Phrases, rounds: list[tuple[tuple[int, ...], np.ndarray]], orders: tuple[int, ...]) -> Iterator[tuple]:
    """(order, first words, fingerprints) of the phrases whose parts of the longest order counted so far are frequent."""
    whole = None
    if rounds:
        size, frequent = rounds[-1][0][-1], rounds[-1][1]
        first, value = found.fingerprints(size)
        whole = np.zeros(len(found.piece) + LONGEST + 1, np.int64)
        whole[first[_within(value, frequent)]] = 1
        whole = np.r_[0, np.cumsum(whole)]
    for n in orders:
        first, value = found.fingerprints(n)
        if whole is not None:
            parts = n - size + 1
            kept = whole[first + parts] - whole[first] == parts
            first, value = first[kept], value[kept]
        yield n, first, value


def _replayed(row: dict, buckets: int, done: tuple) -> tuple[Phrases, list]:
    """A chunk's words, and its frequent fingerprints of each round that is done."""
    rows, rounds = unpack_rows(row["packed"]), []
    found = phrases_of(rows.column(0), rows.column(1))
    for number, orders in enumerate(done):
        values = np.concatenate([v for _, _, v in _candidates(found, rounds, orders)])
        rounds.append((orders, _frequent(_different(values)[0], buckets, row[f"bits{number}"])))
    return found, rounds


def _deal(buckets: int, done: tuple, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            release()
            found, rounds = _replayed(row, buckets, done)
            values, counts = _different(np.concatenate([v for _, _, v in _candidates(found, rounds, orders)]))
            bounds = _bounds(values, buckets)
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([row["chunk"]] * len(some), pa.int64()),
                    pa.array([_pack(values[a:b], counts[a:b]) for a, b in zip(bounds[some], bounds[some + 1])], pa.binary()),
                ],
                names=["bucket", "chunk", "packed"],
            )

    return run


def _meet(least: int):
    """Adds up the fingerprints of a bucket; one bit for each of a chunk's, for chunks that have a frequent one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release()
        parts = [_unpack(x) for x in table.column("packed").to_pylist()]
        values = np.concatenate([v for v, _ in parts])
        order = np.argsort(values)
        ordered = values[order]
        fresh = np.r_[True, ordered[1:] != ordered[:-1]]
        total = np.add.reduceat(np.concatenate([c for _, c in parts])[order].astype(np.int64), np.flatnonzero(fresh))
        often = np.zeros(len(values), bool)
        often[order] = (total >= least)[np.cumsum(fresh) - 1]
        places = np.cumsum([0, *(len(v) for v, _ in parts)])
        bits = [often[a:b] for a, b in zip(places, places[1:])]
        some = [i for i, x in enumerate(bits) if x.any()]
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()] * len(some), pa.int32()),
                "chunk": table.column("chunk").combine_chunks().take(pa.array(some, pa.int64())),
                "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()),
            }
        )

    return run


def _written(found: Phrases, n: int, first: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, str, bytes, int]]:
    """(number of the fingerprint, language, phrase, count) of runs of ``n`` words; ``which`` numbers their fingerprints."""
    # Most runs of a fingerprint are the words of its first run; the few others are told apart by their bytes.
    least = np.full(int(which.max()) + 1 if len(which) else 0, len(found.piece), np.int64)
    np.minimum.at(least, which, first)
    model = least[which]
    same = found.lang[first] == found.lang[model]
    for j in range(n):
        same &= found.number[first + j] == found.number[model + j]
    counts = np.bincount(which[same], minlength=len(least))
    text = found.joined.tobytes()

    def phrase(at: int) -> tuple[str, bytes]:
        return found.langs[found.lang[at]], text[found.begins[at] : found.begins[at + n] - 1]

    some = np.flatnonzero(counts)
    for number, at, count in zip(some.tolist(), least[some].tolist(), counts[some].tolist()):
        yield number, *phrase(at), count
    others = Counter((number, *phrase(at)) for number, at in zip(which[~same].tolist(), first[~same].tolist()))
    for key, count in others.items():
        yield *key, count


_PHRASE = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.binary()), ("a", pa.int64())])


def _write(buckets: int, done: tuple):
    """The words of a chunk's frequent phrases with their counts, packed, to the bucket of their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            release()
            found, rounds = _replayed(row, buckets, done)
            words = np.bincount(found.lang, minlength=len(found.langs)).tolist()
            rows = [(0, lang, 0, b"", count) for lang, count in zip(found.langs, words)]
            for number, (orders, frequent) in enumerate(rounds):
                bounds = _bounds(frequent, buckets)
                bucket = np.repeat(np.arange(buckets), np.diff(bounds)).tolist()
                for n, first, value in _candidates(found, rounds[:number], orders):
                    kept = _within(value, frequent)
                    which = np.searchsorted(frequent, value[kept])
                    rows += [(bucket[i], lang, n, text, count) for i, lang, text, count in _written(found, n, first[kept], which)]
            rows.sort(key=itemgetter(0))
            parts = []
            for _, own in groupby(rows, itemgetter(0)):
                columns = list(zip(*own))[1:]
                parts.append(pack_rows(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PHRASE)], schema=_PHRASE)))
            some = sorted({r[0] for r in rows})
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "packed"])

    return run


def _add_up(least: int):
    """Counts of a bucket's phrases over all chunks, by their words; those that are too rare go."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release()
        rows = pa.Table.from_batches([unpack_rows(x) for x in table.column("packed").to_pylist()])
        total = rows.group_by(["lang", "n_words", "phrase"]).aggregate([("a", "sum")])
        total = total.filter((pc.field("n_words") == 0) | (pc.field("a_sum") >= least))
        columns = [total.column("lang"), total.column("n_words"), total.column("phrase").cast(pa.string()), total.column("a_sum")]
        return pa.table(columns, names=["lang", "n_words", "phrase", "a"])

    return run


def frequent_phrases(
    docs: DataFrame,
    store: Store,
    least: int = LEAST,
    text_column: str = "text",
    lang_column: str = "lang",
    rounds: tuple = ROUNDS,
) -> DataFrame:
    """``lang``, ``n_words``, ``phrase``, ``a``: every phrase of 1 to 5 words that occurs ``least`` times in its language.

    A row of 0 words and an empty phrase gives the number of all words of a language. Null texts are empty, a null
    language is ``UNKNOWN_LANG``; ids are not looked at, so repeated rows count as often as they are there. Other
    columns are ignored, and an empty table has no phrases. Whole texts are read; a phrase lies inside a piece.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_column).alias("text")
    )
    chunks = write_chunks(rows, store, text=1)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1)
    known = chunks.select("chunk", "packed")
    for number, orders in enumerate(rounds):
        dealt = known.mapInArrow(_deal(buckets, rounds[:number], orders), "bucket int, chunk bigint, packed binary")
        often = dealt.groupBy("bucket").applyInArrow(_meet(least), "bucket int, chunk bigint, bits binary")
        often = often.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"bits{number}"))
        known = known.join(store.keep(often, "frequent"), "chunk", "left")
    written = known.mapInArrow(_write(buckets, rounds), "bucket int, packed binary")
    return written.groupBy("bucket").applyInArrow(_add_up(least), "lang string, n_words int, phrase string, a bigint")


def _joined(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(
    docs: DataFrame,
    store: Store,
    least: int = LEAST,
    best: int = BEST,
    covered: int = COVERED,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """The ``best`` phrases of each language by score: lang, rank, phrase, ``a``, ``l``, ``r``, ``n``, score.

    A phrase of two to five words that occurs ``a`` >= ``least`` times is cut after each of its words; ``l`` and ``r``
    are the frequencies of the parts of the cut with the lowest score, floor(1000 * a * n / (l * r)), the first of
    ties, ``n`` the number of the language's words. A phrase inside a longer one that has at least ``covered``
    percent of its occurrences is left out. Equal scores are put in order by ``a`` and the bytes of the phrase, so
    ranks are distinct. Products are decimals of up to 38 digits, exact up to 10 ** 16 words. Nulls, repeated rows,
    other columns and empty tables are as for ``frequent_phrases``.

    A longer phrase that covers another does so through one with a single word more, as that is no rarer; so only
    those are looked at.
    """
    counted = store.keep(frequent_phrases(docs, store, least, text_column, lang_column), "phrases")
    totals = counted.filter("n_words = 0").select("lang", F.col("a").alias("n"))
    phrases = counted.filter("n_words > 0").select("lang", "phrase", "n_words", "a")
    words, size = F.split("phrase", " "), F.col("n_words")
    longer = phrases.filter("n_words >= 2")

    cut = longer.select("lang", "phrase", "a", words.alias("w"), "n_words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select(
        "lang",
        "phrase",
        "a",
        "k",
        _joined(F.col("w"), F.lit(1), F.col("k")).alias("left"),
        _joined(F.col("w"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"),
    )
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = cut.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cut.join(totals, "lang").withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The phrases of one word less inside a phrase are its beginning and its end.
    inner = longer.filter("n_words > 2").select("lang", "a", words.alias("w"), "n_words")
    inner = inner.select("lang", "a", F.explode(F.array(*(_joined(F.col("w"), F.lit(i), F.col("n_words") - 1) for i in (1, 2)))).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    )
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = first_n(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], best, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
