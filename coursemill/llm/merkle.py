"""A Merkle manifest of a data set, kept as a log of nodes in postorder.

Every row is a leaf of its tree; in a tree each two neighbours become their parent, a last one without a neighbour
becomes a parent alone, until one node remains. Aligned builders work on ``2 ** HEIGHT`` leaves each: they append
every node to their log once its last leaf is there, so the log is in postorder. The tops of the builders' parts
are the leaves of the next stage, until each tree has one part; the trees' roots are then leaves of one more tree.

No node is searched for. A complete subtree of height h whose last leaf has the number i is at the place
2 * i - ones(i) + h of its log: 2 * i - ones(i) nodes are complete before the leaf i, and the subtree's right edge
follows it. Nodes that close before they are full come after all complete ones, lowest first. So a leaf's siblings
are read off at computed places, stage by stage, and make its proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from coursemill.operators.numbering import number_rows
from coursemill.store import Store

from .common import ship

#: A builder takes this many levels: 1024 leaves at most.
HEIGHT = 10
#: In a proof, a byte before each sibling says on which side it is; a level without sibling is that byte alone.
ALONE, LEFT, RIGHT = 0, 1, 2


def field(value: Column) -> Column:
    """A value as text: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 of the values of a row, as 32 bytes; never null."""
    return F.unhex(F.coalesce(F.sha2(F.concat(*map(field, values)), 256), F.lit("")))


def parent(*children: bytes) -> bytes:
    """SHA-256 of the children's hexadecimal texts, one after the other."""
    return sha256("".join(x.hex() for x in children).encode()).digest()


def height_of(part: int, leaves: int, height: int) -> int:
    """Levels of a part above its leaves. The first part of a tree is the whole tree if it is not full."""
    return height if part else (leaves - 1).bit_length()


def build(digests: list[bytes], levels: int) -> list[bytes]:
    """The nodes of a part in the order in which they are complete; the last one is its top."""
    log, waiting = [], [b""] * (levels + 1)
    for i, node in enumerate(digests):
        log.append(node)
        level = 0
        while i >> level & 1:
            node = parent(waiting[level], node)
            log.append(node)
            level += 1
        waiting[level] = node
    edge = None  # the node of this level that is not full
    for level in range(levels):
        if len(digests) >> level & 1:
            edge = parent(waiting[level], edge) if edge else parent(waiting[level])
        elif edge:
            edge = parent(edge)
        if edge:
            log.append(edge)
    return log


def place(level: int, number: np.ndarray, leaves: int) -> np.ndarray:
    """Places in a part's log of the nodes with these numbers on a level."""
    last = ((number + 1) << level) - 1
    full = 2 * last - np.bitwise_count(last).astype(np.int64) + level
    lowest = (leaves & -leaves).bit_length() - 1  # the level above it is the first that is not full
    return np.where(last < leaves, full, 2 * leaves - leaves.bit_count() + level - lowest - 1)


def local_proofs(log: bytes, leaves: int, levels: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Leaves of a part, and for every level each leaf's side byte and sibling (32 bytes; of no use for ``ALONE``)."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, 32)
    at, found = np.arange(leaves), []
    for level in range(levels):
        sibling = (at >> level) ^ 1
        there = sibling << level < leaves
        side = np.where(there, np.where(sibling & 1, RIGHT, LEFT), ALONE)
        found.append((side, nodes[place(level, np.where(there, sibling, 0), leaves)]))
    return nodes[place(0, at, leaves)], found


def steps(proof: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(proof):
        side = proof[at]
        end = at + 1 + (32 if side != ALONE else 0)
        yield side, proof[at + 1 : end]
        at = end


def fold(node: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, sibling in steps(proof):
        node = parent(node) if side == ALONE else parent(sibling, node) if side == LEFT else parent(node, sibling)
    return node


@dataclass
class Log:
    """Written parts of all trees by stage: tree, part, leaves, log, and what was carried with the leaves."""

    stages: list[DataFrame]
    height: int


def _build(height: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (tree, part), group in groupby(rows, lambda r: (r[0], r[1])):
            _, _, digests, *carried = (list(c) for c in zip(*group))
            log = build(digests, height_of(part, len(digests), height))
            values = [[tree], [part], [len(digests)], [b"".join(log)], *([c] for c in carried)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def _stage(nodes: DataFrame, height: int, store: Store) -> DataFrame:
    """Parts of the trees of ``nodes``: tree, number (from 0), digest, and columns to carry."""
    carried = nodes.columns[3:]
    rows = nodes.select("tree", F.shiftright("number", height).alias("part"), "digest", *carried, "number")
    out = rows.select(
        "tree",
        "part",
        F.lit(0).cast("bigint").alias("leaves"),
        F.col("digest").alias("log"),
        *(F.array(c).alias(c) for c in carried),
    ).schema
    dealt = rows.repartition("tree", "part").sortWithinPartitions("tree", "part", "number").drop("number")
    return store.keep(dealt.mapInArrow(_build(height, to_arrow_schema(out)), out), "merkle-log")


def _stages(nodes: DataFrame, height: int, store: Store) -> tuple[Log, DataFrame]:
    """The log of all stages, and each tree's root (tree, digest). Every stage has 2 ** height times fewer rows."""
    stages = [_stage(nodes, height, store)]
    while stages[-1].filter("part > 0").limit(1).count():
        tops = stages[-1].select("tree", F.col("part").alias("number"), _top())
        stages.append(_stage(tops, height, store))
    return Log(stages, height), stages[-1].select("tree", _top())


def _top() -> Column:
    return F.expr("substring(log, octet_length(log) - 31, 32)").alias("digest")


@dataclass
class Manifest:
    trees: Log
    forest: Log
    subroots: DataFrame  # tree, digest


def manifest(rows: DataFrame, store: Store, height: int = HEIGHT) -> Manifest:
    """The log of the trees of ``rows`` (``tree``, ``id``, ``digest`` of 32 bytes, and columns to carry along).

    In a tree leaves ascend by id, nulls first, rows that repeat an id by digest. Trees ascend by the bytes of their
    names, null first, as do the leaves of the tree above them. Rows with equal id and digest are neighbours and
    each a leaf. The rows' positions are found by a range sort of these narrow rows, whatever share of them one tree
    has; texts are hashed where they are. An empty table has no tree and no root.
    """
    ship(rows.sparkSession)
    named = F.when(F.col("tree").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    kept = store.keep(rows.withColumn("tree", named), "merkle-leaves")
    numbered = number_rows(kept, ["tree"], [F.asc_nulls_first("id"), F.asc("digest")], store, "_at")
    carried = [c for c in rows.columns if c not in ("tree", "digest")]
    nodes = numbered.select("tree", (F.col("_at") - 1).alias("number"), "digest", *carried)
    trees, subroots = _stages(nodes, height, store)
    # "-" comes before "=", so null comes first.
    above = number_rows(subroots, [], [F.asc("tree")], store, "_at")
    above = above.select(F.lit("").alias("tree"), (F.col("_at") - 1).alias("number"), "digest", F.col("tree").alias("id"))
    return Manifest(trees, _stages(above, height, store)[0], subroots)


def _prove(height: int, columns: int):
    """Proofs of the leaves of parts: number or what was carried, leaf and proof, with the tree's own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                tree, part, leaves, log, above = (row.column(i)[0].as_py() for i in range(5))
                digests, levels = local_proofs(log, leaves, height_of(part, leaves, height))
                proofs = [bytearray() for _ in range(leaves)]
                for side, siblings in levels:
                    for proof, s, sibling in zip(proofs, side.tolist(), siblings):
                        proof.append(s)
                        if s != ALONE:
                            proof += sibling.tobytes()
                again = [pa.array([row.column(i)[0].as_py()] * leaves, row.column(i).type) for i in range(5, 5 + columns)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * leaves, pa.string()),
                        pa.array(np.arange(leaves) + (part << height), pa.int64()),
                        pa.array([d.tobytes() for d in digests], pa.binary()),
                        pa.array([bytes(p) + above for p in proofs], pa.binary()),
                        *again,
                        *(c.flatten() for c in row.columns[5 + columns :]),
                    ],
                    names=[f"c{i}" for i in range(row.num_columns - 1)],
                )

    return run


def _proved(log: Log, tops: DataFrame) -> DataFrame:
    """Every leaf of a log with its proof; ``tops`` has a row for each tree: tree, proof, and columns to repeat."""
    repeated = tops.columns[2:]
    above = tops.withColumn("part", F.lit(0).cast("bigint"))
    for parts in reversed(log.stages):
        carried = parts.columns[4:]
        rows = parts.join(above, ["tree", "part"]).select("tree", "part", "leaves", "log", "proof", *repeated, *carried)
        kind = rows.schema
        fields = [f"{c} {kind[c].dataType.simpleString()}" for c in repeated]
        fields += [f"{c} {kind[c].dataType.elementType.simpleString()}" for c in carried]
        schema = ", ".join(["tree string, part bigint, digest binary, proof binary", *fields])
        above = rows.mapInArrow(_prove(log.height, len(repeated)), schema)
    return above.drop("part")


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf: ``digest``, ``proof``, ``subroot``, ``root``, ``id`` and the columns carried along.

    A proof has the siblings from the leaf to the root, each behind a byte for its side; ``fold`` follows it. Stages
    are joined part by part, from the top; no row is joined with another row, and no node is searched for.
    """
    top = made.forest.stages[-1].select("tree", F.lit(b"").alias("proof"), _top().alias("root"))
    subtrees = _proved(made.forest, top).select(F.col("id").alias("tree"), "proof", "root", F.col("digest").alias("subroot"))
    return _proved(made.trees, subtrees).drop("tree")


def folded(proved: DataFrame, leaf_column: str) -> DataFrame:
    """``proved`` with ``proof_sha256`` (of the siblings' hexadecimal texts) and ``folded``, the root that the leaf in
    ``leaf_column`` leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_proofs = batch.column(batch.schema.names.index("proof")).to_pylist()
            leaves = batch.column(batch.schema.names.index(leaf_column)).to_pylist()
            said = [sha256("".join(s.hex() for _, s in steps(p)).encode()).hexdigest() for p in all_proofs]
            roots = [fold(x, p) for x, p in zip(leaves, all_proofs)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(said, pa.string()), pa.array(roots, pa.binary())],
                names=[*batch.schema.names, "proof_sha256", "folded"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema)
    return proved.mapInArrow(run, f"{schema}, proof_sha256 string, folded binary")
