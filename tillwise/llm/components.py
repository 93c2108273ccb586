"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the roots, with its root: the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):  # hook the root of each end to the lower of the two labels
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(label, before):
            break
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _shrunk(edges: DataFrame) -> DataFrame:
    """The edges of each partition reduced to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 1 << 20:  # what is held stays within the number of nodes
                held = [spanning_forest(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
        if held:
            a, b = spanning_forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Link the larger (large) or the other smaller (small) neighbours of each node to its smallest one.

    The smallest neighbours are a written table, so that the join back can split a hub's edges.
    """
    if large:
        sides = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.keep(sides.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m").toDF("a", "b"))
    return scratch.keep(out.where("a <> b").distinct(), "star-edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of each node that has an edge ``a, b`` (longs); a component is named by its smallest node.

    Edges are first reduced inside each partition; then stars are formed until nothing changes, a
    logarithmic number of rounds in practice. No node's edges are gathered in one task.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(_shrunk(edges.where("a <> b")), "forest")
    mark = None
    while True:
        edges = _star(_star(edges, True, scratch), False, scratch)
        scratch.tidy(1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
