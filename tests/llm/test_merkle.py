from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.llm.merkle import build, field, fold, folded, leaf, manifest, place, proofs


def digest(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def root_and_proofs(nodes):
    """The contract on a list of hexadecimal nodes: root, and each leaf's siblings as (side, node) or None by level."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, i in zip(found, at):
            sibling = i ^ 1
            own.append((sibling < i, nodes[sibling]) if sibling < len(nodes) else None)
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], found


def expected(rows):
    """(id, leaf, subroot, root, siblings) of rows (tree, id, leaf)."""
    trees = {}
    for tree, i, node in rows:
        trees.setdefault(tree, []).append((i is not None, i or 0, node))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    each = {t: (sorted(trees[t]), *root_and_proofs([n for *_, n in sorted(trees[t])])) for t in names}
    root, above = root_and_proofs([each[t][1] for t in names])
    out = []
    for t, upper in zip(names, above):
        leaves, subroot, paths = each[t]
        for (there, i, node), path in zip(leaves, paths):
            siblings = [s[1] for s in path + upper if s]
            out.append((i if there else None, node, subroot, root, digest(*siblings)))
    return sorted(out, key=str)


@pytest.mark.parametrize("leaves", [*range(1, 20), 31, 32, 33, 63, 64])
@pytest.mark.parametrize("more", [0, 2])
def test_places_in_the_log(leaves, more):
    """Every node is where the closed form says, children come before their parents, and the top is last."""
    digests = [sha256(str(i).encode()).digest() for i in range(leaves)]
    levels = (leaves - 1).bit_length() + more
    log = build(digests, levels)
    nodes, seen = [d.hex() for d in digests], set()
    for level in range(levels + 1):
        at = place(level, np.arange(len(nodes)), leaves)
        assert [log[i].hex() for i in at] == nodes
        assert not seen & set(at.tolist())
        seen |= set(at.tolist())
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    assert seen == set(range(len(log))) and max(seen) == at[-1]


CASES = {
    "one": [("a", 1)],
    "trees": [(t, i) for t in ("en", None, "", "é", "-", "=") for i in range(len(t or "xyz") * 3)],
    "sizes": [(str(n), i) for n in range(1, 34) for i in range(n)],
    "hot": [("a", i) for i in range(300)] + [("b", 1)],
    "ties": [("a", 1), ("a", 1), ("a", None), ("a", None), ("a", 2), (None, None), (None, 1)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("height", [2, 10])
def test_proofs(spark, store, case, height):
    rows = [(t, i, digest(str(n % 3 if case == "ties" else n))) for n, (t, i) in enumerate(CASES[case])]
    table = spark.createDataFrame(rows, "tree string, id bigint, hex string").select("tree", "id", F.unhex("hex").alias("digest"))
    proved = folded(proofs(manifest(table, store, height)), "digest")
    found = [
        (r["id"], r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof_sha256"]) for r in proved.collect()
    ]
    assert sorted(found, key=str) == expected(rows)
    assert all(r["folded"] == r["root"] for r in proved.collect())


def test_a_changed_leaf_leads_elsewhere(spark, store):
    rows = [("a", i, digest(str(i)), i % 3) for i in range(50)]
    table = spark.createDataFrame(rows, "tree string, id bigint, hex string, n int")
    table = table.select("tree", "id", F.unhex("hex").alias("digest"), F.when(F.col("n") == 0, F.unhex(F.sha2("hex", 256))).alias("changed"))
    proved = proofs(manifest(table, store, 3))
    for r in folded(proved.withColumn("found", F.coalesce("changed", "digest")), "found").collect():
        assert (r["folded"] == r["root"]) == (r["id"] % 3 != 0)
        assert fold(r["digest"], r["proof"]) == r["root"]


def test_fields_and_leaves(spark):
    rows = [(1, "é", None), (-12, "", "x" * 200_000), (None, None, "a:b")]
    table = spark.createDataFrame(rows, "a bigint, b string, c string")
    found = table.select(field(F.col("a")), field(F.col("b")), leaf(F.col("a"), F.col("b"), F.col("c"))).collect()

    def plain(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    assert [(r[0], r[1], r[2].hex()) for r in found] == [(plain(a), plain(b), digest(plain(a), plain(b), plain(c))) for a, b, c in rows]


def test_empty_table(spark, store):
    empty = spark.createDataFrame([], "tree string, id bigint, digest binary")
    assert proofs(manifest(empty, store)).collect() == []


def test_registered_query(spark):
    from checks.compare import connect, difference
    from coursemill.llm.oracles import llm_oracles
    from coursemill.llm.queries import llm_queries

    folder = "/root/testdata/sf0.001"
    answer = llm_queries()["op12_merkle_manifest"](spark, folder)
    assert difference(answer, connect(folder), llm_oracles()["op12_merkle_manifest"]) is None
