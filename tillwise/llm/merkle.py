"""A Merkle tree over a document table, with a version per changed document.

Every row is a leaf: the digest of its columns. Within a source the leaves stand in order of the id; 16
neighbours become their digest, level by level, until one is left, the source's subroot. The subroots, in
order of the source, become the root in the same way.

The tree is persistent. A changed leaf makes a version that shares every untouched node with the
original and copies the changed leaf's ancestors only:

* **Aligned blocks.** 4096 neighbouring leaves of a source, three levels, are a block, built and versioned
  within one task as linked nodes (:class:`Node`); a version copies at most three of them.
* **Upper levels** are tables, one aggregation each, of a 4096th of the rows and less. From the top down each
  node gets its path: where it stands among its siblings, and who they are. A block meets its path by key, and
  each of its versions goes on along the path to a root of its own.

A source that holds most rows has many blocks, so nothing of the size of a source or of the table meets
in one task. A task holds a block: 4096 digests, their nodes and one path.

Defined cases: a null column counts as ``-`` in its leaf; rows without a source are a source of their own, the
first; null ids come first in their source; rows with one id are ordered by their digests, equal rows
in any order; a lone leaf is its own subroot, a lone subroot the root, and the digest of an empty proof
that of the empty text; an empty table has no leaves and gives an empty result. Columns that are not
named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .numbering import numbered

#: Children of a node.
FANOUT = 16
#: Levels of a block.
DEPTH = 3
#: Leaves of a block.
BLOCK = FANOUT**DEPTH
#: What a leaf is the digest of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: Sequence[Column]) -> Column:
    """Digest of values: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings]), 256)


def leaf_table(docs: DataFrame, changed: Column, text: Column, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """``doc_id, grp, leaf, new_leaf``: the leaf of each row, and its leaf with ``text`` in place of the text where ``changed`` holds.

    ``grp`` stands for the source: empty for null, else ``s`` and the source, so that it sorts as the sources do.
    """
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    new = [text if c == "text" else F.col(c) for c in columns]
    return docs.select(
        "doc_id", grp.alias("grp"), digest([F.col(c) for c in columns]).alias("leaf"), F.when(changed, digest(new)).alias("new_leaf")
    )


class Node:
    """An unchangeable node of a block; a leaf has no children."""

    __slots__ = ("children", "digest")

    def __init__(self, digest: str, children: tuple[Node, ...] = ()):
        self.digest, self.children = digest, children


def over(children: Sequence[Node]) -> Node:
    """The node above ``children``."""
    return Node(sha256("".join([c.digest for c in children]).encode()).hexdigest(), tuple(children))


def block_tree(leaves: Sequence[str], whole: bool) -> Node:
    """The tree over a block. ``whole``: the block is all of its source, so the tree ends where one node is left."""
    nodes, level = [Node(x) for x in leaves], 0
    while len(nodes) > 1 if whole else level < DEPTH:
        nodes, level = [over(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)], level + 1
    return nodes[0]


def trail(root: Node, place: int) -> list[tuple[Node, int]]:
    """Ancestors of the leaf at ``place``, from the root down, each with the number of the child to take."""
    height, node = 0, root
    while node.children:
        node, height = node.children[0], height + 1
    steps, node = [], root
    for level in range(height - 1, -1, -1):
        at = place // FANOUT**level % FANOUT
        steps.append((node, at))
        node = node.children[at]
    return steps


def with_leaf(steps: list[tuple[Node, int]], leaf: str) -> list[Node]:
    """A version with another leaf at the end of ``steps``: the copied ancestors, from the lowest up. All else is shared."""
    node, copied = Node(leaf), []
    for old, at in reversed(steps):
        node = over((*old.children[:at], node, *old.children[at + 1 :]))
        copied.append(node)
    return copied


def block_roots(leaves: DataFrame) -> DataFrame:
    """``grp, idx, digest, total``: the node above each block, its number, and how many blocks its source has."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        grp, block, total = (rows.column(c)[0].as_py() for c in ("grp", "block", "total"))
        top = block_tree(rows.column("leaf").to_pylist(), total <= BLOCK)
        return pa.table({"grp": [grp], "idx": [block], "digest": [top.digest], "total": [-(-total // BLOCK)]})

    return leaves.groupBy("grp", "block").applyInArrow(run, "grp string, idx long, digest string, total long")


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``grp, idx, steps, root`` for nodes ``grp, idx, digest, total``: the path of each node to the top of its group.

    ``steps`` lists, from the node up, its place among its siblings and the others' digests. Hand in a
    stored table. Upwards, a level is one aggregation of 16 rows to one; downwards, one join.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels: list[tuple[DataFrame, DataFrame]] = []
    while most > 1:
        ordered = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # 16 at most
        runs = (
            nodes.where("total > 1")
            .groupBy("grp", F.expr(f"idx div {FANOUT}").alias("up"), "total")
            .agg(F.transform(ordered, lambda x: x["digest"]).alias("digests"))
        )
        runs = scratch.keep(runs, f"{name}-runs")
        levels.append((nodes, runs))
        above = F.sha2(F.array_join("digests", ""), 256)
        nodes = runs.select("grp", F.col("up").alias("idx"), above.alias("digest"), F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total"))
        most = -(-most // FANOUT)
    no_steps = F.array().cast("array<struct<at:int,others:array<string>>>")
    tops = lambda level: level.where("total = 1").select("grp", "idx", no_steps.alias("steps"), F.col("digest").alias("root"))
    known = tops(nodes)
    for level, runs in reversed(levels):
        above = known.withColumnRenamed("idx", "up")
        children = runs.join(above, ["grp", "up"]).select("grp", "up", "digests", "steps", "root", F.posexplode("digests").alias("at", "_mine"))
        others = F.filter("digests", lambda _, i: i != F.col("at"))
        step = F.struct(F.col("at").cast("int").alias("at"), others.alias("others"))
        idx = F.col("up") * FANOUT + F.col("at")
        below = children.select("grp", idx.alias("idx"), F.concat(F.array(step), "steps").alias("steps"), "root")
        known = scratch.keep(below.unionByName(tops(level)), f"{name}-paths")
    return known


def follow(digest: str, steps: Sequence[tuple[int, list[str]]]) -> list[str]:
    """Digests of the ancestors that a version copies above its block, from the lowest up."""
    copied = []
    for at, others in steps:
        digest = sha256("".join((*others[:at], digest, *others[at:])).encode()).hexdigest()
        copied.append(digest)
    return copied


def versions(docs: DataFrame, changed: Column, text: Column, columns: Sequence[str] = COLUMNS, proofs: bool = False) -> DataFrame:
    """``doc_id, leaf, new_leaf, subroot, root, proof_sha256, folded_root, verified, copied`` of each row.

    ``copied`` are the ancestors of the version that the row's leaf makes (the changed one, else its own),
    from the lowest to the version's root, ``folded_root``; every other node is the original's. The proof is
    the siblings on the way, level by level and left to right; ``proofs`` adds it as an array.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ship(spark)
    leaves = scratch.keep(leaf_table(docs, changed, text, columns), "merkle-leaves")
    placed = numbered(leaves, "grp", ["doc_id", "leaf"], scratch, "merkle-order")
    placed = placed.withColumn("block", F.expr(f"pos div {BLOCK}"))
    inner = climb(scratch.keep(block_roots(placed), "merkle-blocks"), scratch, "merkle-blocks")
    subroots = scratch.keep(inner.where("idx = 0").select("grp", F.col("root").alias("digest")), "merkle-subroots")
    ranked = numbered(subroots.withColumn("all", F.lit(0)), "all", ["grp"], scratch, "merkle-sources")
    tops = scratch.keep(ranked.select(F.lit("").alias("grp"), F.col("pos").alias("idx"), "digest", "total", F.col("grp").alias("of")), "merkle-tops")
    upper = climb(tops.drop("of"), scratch, "merkle-tops").join(tops.select("idx", "of"), "idx")
    upper = upper.select(F.col("of").alias("grp"), F.col("steps").alias("more"), F.col("root").alias("whole"))
    paths = inner.join(upper, "grp").select(
        "grp", F.col("idx").alias("block"), F.concat("steps", "more").alias("steps"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_kind}, leaf string, new_leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean, copied array<string>" + (", proof array<string>" if proofs else "")
    )

    def run(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        steps = [(s["at"], s["others"]) for s in path.column("steps")[0].as_py()]
        subroot, root = path.column("subroot")[0].as_py(), path.column("root")[0].as_py()
        leaves, fresh = rows.column("leaf").to_pylist(), rows.column("new_leaf").to_pylist()
        tree = block_tree(leaves, rows.column("total")[0].as_py() <= BLOCK)
        above = [x for _, others in steps for x in others]
        tail = "".join(above)
        ways: dict[str, list[str]] = {}  # versions that agree on the block share what is above it
        hashes, ends, copies, lists = [], [], [], []
        for i, (old, new) in enumerate(zip(leaves, fresh)):
            way = trail(tree, i)
            beside = [c.digest for node, at in reversed(way) for k, c in enumerate(node.children) if k != at]
            hashes.append(sha256(("".join(beside) + tail).encode()).hexdigest())
            leaf = old if new is None else new
            copied = [n.digest for n in with_leaf(way, leaf)]
            top = copied[-1] if copied else leaf
            if top not in ways:
                ways[top] = follow(top, steps)
            copied = copied + ways[top]
            copies.append(copied)
            ends.append(copied[-1] if copied else leaf)
            if proofs:
                lists.append(beside + above)
        n = rows.num_rows
        out = {
            "doc_id": rows.column("doc_id"), "leaf": leaves, "new_leaf": pa.array(fresh, pa.string()), "subroot": [subroot] * n,
            "root": [root] * n, "proof_sha256": hashes, "folded_root": ends, "verified": [e == root for e in ends],
            "copied": pa.array(copies, pa.list_(pa.string())),
        }
        if proofs:
            out["proof"] = pa.array(lists, pa.list_(pa.string()))
        return pa.table(out)

    return placed.groupBy("grp", "block").cogroup(paths.groupBy("grp", "block")).applyInArrow(run, schema)
