"""Near duplicates by DartMinHash, banded joining and exact verification.

A document is the weighted set of its five-word shingles; a shingle's weight is the number of times it
occurs. Two documents are near duplicates if their weighted Jaccard similarity, the sum of the smaller
weights over the sum of the larger ones, is at least 0.8.

Each unit of weight of a shingle is a region into which hashed darts fall one after the other, at times that
grow by exponential steps. Each dart belongs to one of ``COORDINATES`` coordinates, and a coordinate keeps its
earliest dart. Equal regions have equal darts, so two documents agree in a coordinate with a probability that
is their similarity. A document throws about t = k (ln k + 3) darts whatever its weight: time ends at t
over the weight, and later for the few documents that leave a coordinate empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.store import Store

from .common import Words, grams, mix, pieces, ship, text_bytes, words_of
from .components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 coordinates: a pair of similarity 0.8 is missed by all bands once in 20,000.
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 3)
#: Buckets with so many different texts at most are compared in full; larger ones through leaders and shared shingles.
SMALL_BUCKET = 8
#: Parts of a larger bucket that each have a leader of their own, besides the bucket's.
PARTS = 16
#: Leaders of either kind that a text of large buckets is compared with.
LEADERS = 2

_DART = np.uint64(0xD1B54A32D192ED03)
_COPY = np.uint64(0xA0761D6478BD642F)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words, but not none, is one shingle of all its words."""
    owner, counts = words.text, np.diff(words.first)
    all_grams = grams(words.hashes, size)
    inside = owner[: len(all_grams)] == owner[size - 1 :] if len(all_grams) else np.zeros(0, bool)
    owners, hashes = [owner[: len(all_grams)][inside]], [all_grams[inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            owners.append(short)
            hashes.append(grams(words.hashes[words.first[short][:, None] + np.arange(n)], n)[:, 0])
    return np.concatenate(owners), np.concatenate(hashes)


def regions(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every unit of weight: the first, second, ... occurrence of a shingle in its text."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    begins = np.flatnonzero(fresh)
    copy = np.arange(len(owner)) - np.repeat(begins, np.diff([*begins, len(owner)]))
    return owner, mix(hashes + copy.astype(np.uint64) * _COPY)


def _throw(owner: np.ndarray, region: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
    """Throw the darts of all regions until the ``end`` of their texts; ``out`` keeps the earliest times."""
    time = np.zeros(len(region))
    key, until = region.copy(), end[owner]
    while len(key):
        key = mix(key + _DART)
        time = time - np.log(((key >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53))
        hit = time <= until
        key, time, owner, until = key[hit], time[hit], owner[hit], until[hit]
        coordinate = (mix(key ^ _COPY) % np.uint64(COORDINATES)).astype(np.int64)
        np.minimum.at(out.reshape(-1), owner * COORDINATES + coordinate, time)


def signatures(owner: np.ndarray, region: np.ndarray, n: int) -> np.ndarray:
    """n x COORDINATES earliest times; infinite for texts without shingles."""
    out = np.full((n, COORDINATES), np.inf)
    weight = np.bincount(owner, minlength=n)
    end = DARTS / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        chosen = todo[owner]
        _throw(owner[chosen], region[chosen], end, out)
        todo &= np.isinf(out).any(axis=1)
        end = end * 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the coordinates of each band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _COPY
    for row in range(ROWS):
        total = mix(total + bits[:, :, row])
    return total


def contents(owner: np.ndarray, region: np.ndarray, n: int) -> list[bytes | None]:
    """A 128-bit name of each text's weighted set; null for texts without shingles."""
    halves = np.zeros((n, 2), np.uint64)
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    for half, salt in enumerate((np.uint64(1), _DART)):
        if len(begins):
            halves[owner[begins], half] = np.add.reduceat(mix(region ^ salt), begins)
    some = np.zeros(n, bool)
    some[owner] = True
    return [x.tobytes() if keep else None for x, keep in zip(halves, some)]


def _regions_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return regions(*shingles(words_of(*text_bytes(column))))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in pieces(b)):
        owner, region = _regions_of(piece.column(1))
        hashed = bands(signatures(owner, region, piece.num_rows)).view(np.int64)
        flat = pa.ListArray.from_arrays(
            pa.array(np.arange(piece.num_rows + 1) * BANDS, pa.int32()), pa.array(hashed.reshape(-1))
        )
        names = pa.array(contents(owner, region, piece.num_rows), pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column(0), names, flat], names=["_id", "_node", "_bands"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in pieces(b)):
        owner, region = _regions_of(piece.column(1))
        names = pa.array(contents(owner, region, piece.num_rows), pa.binary())
        yield pa.RecordBatch.from_arrays([names, piece.column(1)], names=["_node", "_text"])


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts. Units of weight are told apart, so it counts sets."""
    n = len(left)
    sides = [_regions_of(column) for column in (left, right)]
    sizes = [np.bincount(owner, minlength=n) for owner, _ in sides]
    owner = np.concatenate([o for o, _ in sides])
    region = np.concatenate([r for _, r in sides])
    order = np.lexsort((region, owner))
    owner, region = owner[order], region[order]
    shared = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (region[1:] == region[:-1])], minlength=n)
    return shared / np.maximum(sizes[0] + sizes[1] - shared, 1)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for q in pieces(b, 2) for p in pieces(q, 3)):
            near = pa.array(similarities(piece.column(2), piece.column(3)) >= threshold)
            yield piece.select(["a", "b"]).filter(near)

    return verify


def near_duplicates(
    docs: DataFrame,
    store: Store,
    threshold: float = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (smallest id of its class) and ``class_size`` in rows.

    A class is a connected component of links; a link is a pair of texts of at least ``threshold``, verified
    on the texts. Texts with the same weighted set are one node, so copies never make pairs. In a bucket of
    up to ``SMALL_BUCKET`` nodes all pairs are verified. A larger bucket, which a third of all documents may
    share, is never paired in full: its nodes are compared with leaders of their buckets and leaders of one of
    ``PARTS`` parts of each, ``LEADERS`` of either kind, whatever the size of the group. That joins most of what belongs together; links between the components that are
    left in a large bucket are all found by the units of weight that their texts share (``_remainder``).

    Null and empty texts, and others without a word, are alone: their class is their own id, their size 1.
    Classes of rows with null ids take the smallest id that is not null. Rows that repeat a text share a
    class; rows that repeat an id with other texts are judged by their texts. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    signed = store.keep(rows.mapInArrow(_sign, f"_id {kind}, _node binary, _bands array<bigint>"), "signatures")
    nodes = signed.filter("_node is not null").dropDuplicates(["_node"])
    entries = nodes.select("_node", F.explode("_bands").alias("_bucket"))
    sizes = entries.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_node").alias("_leader"))
    members = store.keep(entries.join(sizes.filter("_n > 1"), "_bucket"), "buckets")

    pairs = store.keep(_first_pairs(members), "pairs")
    large = members.filter(F.col("_n") > SMALL_BUCKET).select("_bucket", "_node")
    wanted = pairs.select(F.col("a").alias("_node")).unionAll(pairs.select(F.col("b").alias("_node")))
    wanted = wanted.unionAll(large.select("_node")).distinct()
    named = rows.filter("_text is not null").select("_id", "_text").mapInArrow(_named, "_node binary, _text string")
    texts = store.keep(named.join(wanted, "_node", "left_semi").dropDuplicates(["_node"]), "texts")
    roots = store.keep(components(_links(pairs, texts, threshold, store), store), "roots")
    if not large.isEmpty():
        roots = _remainder(large, texts, roots, threshold, store)

    placed = signed.select("_id", "_node").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    placed = placed.withColumn("_root", F.coalesce("root", "_node"))
    classes = placed.filter("_root is not null").groupBy("_root").agg(
        F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_size")
    )
    found = placed.select("_id", "_root").join(classes, "_root", "left")
    return found.select(
        F.col("_id").alias(id_column),
        F.when(F.col("_root").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("class_size"),
    )


def _pair(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _first_pairs(members: DataFrame) -> DataFrame:
    """All pairs of small buckets; pairs with the leaders of large ones."""
    few = members.filter(F.col("_n") <= SMALL_BUCKET).groupBy("_bucket").agg(F.collect_list("_node").alias("_nodes"))
    few = few.select(F.array_sort("_nodes").alias("_nodes")).distinct()
    few = few.select("_nodes", F.posexplode("_nodes").alias("_at", "_one"))
    few = few.select("_one", F.explode(F.slice("_nodes", F.lit(1), F.col("_at"))).alias("_other"))
    many = members.filter(F.col("_n") > SMALL_BUCKET)
    many = many.withColumn("_part", F.pmod(F.xxhash64("_bucket", "_node"), F.lit(PARTS)))
    heads = many.groupBy("_bucket", "_part").agg(F.min("_node").alias("_head"))
    stars = _most_shared(many, "_leader").unionAll(_most_shared(many.join(heads, ["_bucket", "_part"]), "_head"))
    return few.unionAll(stars).filter("_one <> _other").select(*_pair("_one", "_other")).distinct()


def _most_shared(many: DataFrame, leader: str) -> DataFrame:
    """Each node with the ``LEADERS`` leaders that it shares most buckets with: these are likeliest to be near it.

    A node has a leader for each of ``BANDS`` buckets at most. What no leader joins is left to ``_remainder``.
    """
    shared = many.groupBy("_node", leader).agg(F.count(F.lit(1)).alias("_shared"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_shared")).alias("rank"), F.col(leader).alias("leader"))))
    best = shared.filter(F.col("_node") != F.col(leader)).groupBy("_node").agg(F.slice(ranked, 1, LEADERS).alias("_best"))
    best = best.select(F.col("_node").alias("_one"), F.explode("_best").alias("_best"))
    return best.select("_one", F.col("_best.leader").alias("_other"))


def _placed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    placed = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    return placed.withColumn("_root", F.coalesce("root", "_node")).drop("root")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in pieces(b)):
        owner, region = _regions_of(piece.column(1))
        size = np.bincount(owner, minlength=piece.num_rows)[owner]
        columns = [piece.column(0).take(pa.array(owner)), pa.array(size, pa.int64()), pa.array(region.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["_node", "_size", "_unit"])


def _remainder(large: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float, store: Store) -> DataFrame:
    """``roots`` with all links between nodes of large buckets that have several components.

    Two texts of ``threshold`` have a unit of weight in common, and the one with fewest holders is among the first
    n - threshold * n + 1 of both, ordered by holders. Only these first units are joined.
    """
    buckets = _placed(large, roots).groupBy("_bucket").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"))
    wanted = large.join(buckets.filter("_low <> _high"), "_bucket", "left_semi").select("_node").distinct()
    units = texts.join(wanted, "_node", "left_semi").select("_node", "_text")
    units = store.keep(units.mapInArrow(_units, "_node binary, _size bigint, _unit bigint"), "units")
    holders = units.groupBy("_unit").agg(F.count(F.lit(1)).alias("_held")).filter("_held > 1")
    of_node = Window.partitionBy("_node")
    place = F.row_number().over(of_node.orderBy("_held", "_unit")) - F.count(F.lit(1)).over(of_node)
    first = units.join(holders, "_unit").withColumn("_left", 1 - place)
    first = first.filter(F.col("_left") >= threshold * F.col("_size") - 1e-6).drop("_held")
    first = store.keep(_placed(first, roots), "first-units")
    pairs = store.keep(_unit_pairs(first, threshold), "pairs")
    fresh = _links(pairs, texts, threshold, store)
    return components(fresh.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), store)


def _unit_pairs(units: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different components with a common unit, if they can be of ``threshold`` by size and place.

    ``_left`` counts a text's units from this one on. If it is the common unit with fewest holders, all that the
    two share is among these. A pair of ``threshold`` shares 2 * threshold / (1 + threshold) of its smaller text, so one
    side has to have so many units left (``_small``); a widely held unit is followed by so many in few texts. A
    unit's most frequent component is not joined with itself, nor is any other.
    """
    part = threshold / (1 + threshold)
    units = units.withColumn("_small", F.col("_left") >= 2 * part * F.col("_size") - 1e-6)
    counts = units.groupBy("_unit", "_root").agg(F.count(F.lit(1)).alias("_n"), F.max("_small").alias("_any"))
    most = counts.groupBy("_unit").agg(
        F.max_by("_root", "_n").alias("_most"), F.count(F.lit(1)).alias("_kinds"), F.max("_any").alias("_any")
    )
    units = units.join(most.filter("_kinds > 1 and _any").drop("_any"), "_unit")
    fits = F.when(F.col("_small"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    one = units.filter("_root <> _most").withColumn("_other", F.explode(fits))
    one = one.select("_unit", F.col("_other").alias("_small"), *(F.col(c).alias(c + "1") for c in ("_node", "_root", "_size", "_left")))
    both = one.join(units, ["_unit", "_small"]).filter("_root <> _root1")
    both = both.filter(F.least("_left", "_left1") >= part * F.expr("_size + _size1") - 1e-6)
    return both.select(*_pair("_node", "_node1")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, threshold: float, store: Store) -> DataFrame:
    left = texts.select(F.col("_node").alias("a"), F.col("_text").alias("_left"))
    right = texts.select(F.col("_node").alias("b"), F.col("_text").alias("_right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right")
    return store.keep(both.mapInArrow(_verify(threshold), "a binary, b binary"), "links")
