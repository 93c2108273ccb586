"""Classification trees and forests with node-wise cuts, grown level by level, all trees at once.

A node is split at the cut of least weighted Gini impurity; its candidates are 16 quantiles from 5 to 95 %
of each feature *within the node*, and a value equal to the cut goes left. A node is a leaf at the depth
limit, below the minimum size, when pure, or when no cut lowers its impurity.

* **Large nodes** are split together, a level of all trees at a time, in two scans of the table, which is stored
  once, a row an input row with its copies in every tree; its node in a tree follows from the splits found so far. The first
  scan counts copies per (tree, node, feature, bin), where a bin is one of at most ``BINS`` values or the gap between two.
  The counts say in which bins a node's quantiles lie; the second scan fetches the values of those gaps only, so
  the quantiles and the counts at the cuts are exact whatever the bins. Counts of a task are sent as one row a node.
* **Small nodes**, of at most ``LOCAL`` rows, are finished where they are: their rows meet in one task, as packed
  columns, which grows the rest of the subtree with sorted columns. Trees take turns, so that at most ``TURN`` rows move at a time.

Both ways give the same tree. Nothing larger than ``LOCAL`` rows meets in one task, and the driver sees nodes only.

A forest's trees draw rows with replacement (:mod:`..operators.bootstrap`) and features by hash of tree and
node, so that a forest is the same on every cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clean, flag
from ..operators.bootstrap import bootstrap_arrays
from ..operators.scaling import fit_means, impute
from ..session import Stages, ship_package

#: Quantiles of a node's rows that are tried as cuts.
CUTS = [float(q) for q in np.linspace(0.05, 0.95, 16)]
#: Rows of a node, copies included, that one task may hold.
LOCAL = 200_000
#: Values of a feature that part its bins.
BINS = 511
#: Of the sketch behind these values; the result does not depend on it.
ACCURACY = 5_000
#: Rows that a task reads at a time.
CHUNK = 1 << 16
#: Rows of all trees that move to their subtrees at a time.
TURN = 1 << 27

NODE_SCHEMA = "tree int, node long, feature int, threshold double, value int, n long, gini double, score double"


@dataclass
class TreeModel:
    """Trees as node rows. The root is node 1, the children of k are 2k (left) and 2k + 1."""

    features: list[str]
    means: dict[str, float]
    nodes: list[tuple]  # rows of NODE_SCHEMA; feature -1 in leaves
    trees: int
    votes: bool  # a forest: the score is the share of votes

    def by_tree(self) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in range(self.trees)]
        for row in self.nodes:
            out[row[0]].append(row)
        return out

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per tree: feature, threshold, left child's place, class; children stand side by side."""
        out = []
        for mine in self.by_tree():
            mine.sort(key=lambda r: r[1])
            place = {r[1]: i for i, r in enumerate(mine)}
            left = np.array([place.get(2 * r[1], i) for i, r in enumerate(mine)])
            out.append((np.array([r[2] for r in mine]), np.array([r[3] or 0.0 for r in mine]), left, np.array([r[4] for r in mine])))
        return out

    def share(self) -> Column:
        """Share of trees that vote for class 1."""
        tables = self.tables()

        @F.pandas_udf("double")
        def votes(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(float) for c in batch])
                found = np.zeros(len(x))
                for feature, threshold, left, value in tables:
                    at = np.zeros(len(x), np.int64)
                    while True:
                        f = feature[at]
                        go = np.flatnonzero(f >= 0)
                        if not len(go):
                            break
                        at[go] = left[at[go]] + (x[go, f[go]] > threshold[at[go]])
                    found += value[at]
                yield pd.Series(found / len(tables))

        return votes(*[settled(F.coalesce(clean(f), F.lit(self.means[f]))) for f in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """A forest's ``score`` is its share of votes; class 1 from one half on. A tree has a class only."""
        ship_package(df.sparkSession)
        if self.votes:
            return df.withColumn("score", self.share()).withColumn("prediction", flag(F.col("score") >= 0.5).cast("double"))
        return df.withColumn("prediction", self.share())

    def rows(self, spark) -> DataFrame:
        """The node table, with the features' names and each split's impurity decrease, weighted by its node's share of rows."""
        names = F.array(*[F.lit(f) for f in self.features])
        table = spark.createDataFrame(self.nodes, NODE_SCHEMA)
        whole = F.max(F.when(F.col("node") == 1, F.col("n"))).over(Window.partitionBy("tree"))
        gain = F.when(F.col("feature") >= 0, (F.col("gini") - F.col("score")) * F.col("n") / whole)
        return table.withColumn("gain", gain).withColumn("feature", F.when(F.col("feature") >= 0, names[F.col("feature")]))

    def importances(self) -> list[float]:
        """Impurity decrease per feature, a share of each tree's, averaged over the trees."""
        out = np.zeros(len(self.features))
        for mine in self.by_tree():
            whole = max((r[5] for r in mine if r[1] == 1), default=1)
            gains = np.zeros(len(self.features))
            for _, _, f, _, _, n, gini, score in mine:
                if f >= 0:
                    gains[f] += (gini - score) * n / whole
            out += gains / (gains.sum() or 1.0)
        return [float(v) for v in out / self.trees]

    def usage(self) -> dict[str, int]:
        """How many splits use each feature."""
        used = [r[2] for r in self.nodes if r[2] >= 0]
        return {self.features[f]: used.count(f) for f in sorted(set(used))}


def gini(n: np.ndarray | float, p: np.ndarray | float):
    """Impurity of ``n`` rows with ``p`` of class 1."""
    one = p / n
    zero = 1.0 - one
    return 1.0 - (zero * zero + one * one)


def chosen(tree: int, node: int, features: int, take: int, seed: int) -> list[int]:
    """``take`` features of a node, by the order of a hash; all if there are no more."""
    if take >= features:
        return list(range(features))
    mark = lambda f: hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest()
    return sorted(sorted(range(features), key=mark)[:take])


def best_of(cuts: np.ndarray, left: np.ndarray, in_left: np.ndarray, n: int, ones: int) -> tuple[float, float, int, int] | None:
    """Threshold, impurity, and the left side's rows and rows of class 1, of a feature's best cut; ties go to the lower cut."""
    cuts, first = np.unique(cuts, return_index=True)
    left, in_left = left[first].astype(float), in_left[first].astype(float)
    keep = (left > 0) & (left < n)
    if not keep.any():
        return None
    cuts, left, in_left = cuts[keep], left[keep], in_left[keep]
    score = left / n * gini(left, in_left) + (n - left) / n * gini(n - left, ones - in_left)
    k = int(np.argmin(score))
    return float(cuts[k]), float(score[k]), int(left[k]), int(in_left[k])


def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the quantiles of ``n`` rows lie: between which two places of the sorted rows, and how far from the first."""
    place = np.array(CUTS) * (n - 1)
    low = np.floor(place).astype(np.int64)
    return low, np.ceil(place).astype(np.int64), place - low


def best_cut(x: Sequence[np.ndarray], y: np.ndarray, w: np.ndarray, candidates: Sequence[int]) -> tuple[int, float, float] | None:
    """Feature, threshold and impurity of the best cut of ``w`` copies of each row; ties go to the first feature and the lower cut."""
    n, ones = int(w.sum()), int(w @ y)
    low, high, part = places(n)
    best = None
    for f, column in zip(candidates, x):
        order = np.argsort(column)
        v, upto = column[order], np.cumsum(w[order])
        first, second = v[np.searchsorted(upto, low, side="right")], v[np.searchsorted(upto, high, side="right")]
        cuts = np.round(first + (second - first) * part, 9)
        at = np.searchsorted(v, cuts, side="right") - 1  # a cut is no less than its first value
        found = best_of(cuts, upto[at], np.cumsum((w * y)[order])[at], n, ones)
        if found and (best is None or found[1] < best[2]):
            best = (f, *found[:2])
    return best


@dataclass(frozen=True)
class Rule:
    """When and how to split."""

    depth: int = 10
    least: int = 20
    take: int | None = None  # features a node looks at; None: all
    seed: int = 42

    def candidates(self, tree: int, node: int, features: int) -> list[int]:
        return chosen(tree, node, features, self.take or features, self.seed)


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, rule: Rule) -> list[tuple]:
    """Node rows of the subtree below ``root`` over rows in memory: a row of ``x`` a feature, ``w`` copies of each column."""
    out, todo = [], [(root, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        mine, copies = y[rows], w[rows]
        n, ones = int(copies.sum()), int(copies @ mine)
        impurity = float(gini(float(n), float(ones)))
        found = None
        if node.bit_length() - 1 < rule.depth and n >= rule.least and 0 < ones < n:
            some = rule.candidates(tree, node, len(x))
            found = best_cut([x[f][rows] for f in some], mine, copies, some)
        value = int(ones >= n - ones)
        if found is None or found[2] >= impurity:
            out.append((tree, node, -1, None, value, n, impurity, None))
            continue
        f, cut, score = found
        out.append((tree, node, f, cut, value, n, impurity, score))
        right = x[f][rows] > cut
        todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return out


#: Splits found so far, by tree: node -> (feature, cut).
Grown = Mapping[int, Mapping[int, tuple[int, float]]]


def chunks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Values (a row a feature), classes and copies (a row a tree) of about ``CHUNK`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def read():
        table = pa.Table.from_batches(held)
        x = np.array([table.column(f"x{i}").to_numpy() for i in range(features)])
        w = np.frombuffer(b"".join(table.column("w").to_pylist()), np.uint8).reshape(len(table), -1)
        return x, table.column("y").to_numpy().astype(np.int64), np.ascontiguousarray(w.T)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield read()
            held = []
    if sum(b.num_rows for b in held):
        yield read()


def standing(x: np.ndarray, rows: np.ndarray, splits: Mapping[int, tuple[int, float]]) -> np.ndarray:
    """The node that each of ``rows`` has reached."""
    nodes = sorted({1, *(c for n in splits for c in (n, 2 * n, 2 * n + 1))})
    place = {n: i for i, n in enumerate(nodes)}
    feature = np.array([splits[n][0] if n in splits else -1 for n in nodes])
    cut = np.array([splits[n][1] if n in splits else 0.0 for n in nodes])
    left = np.array([place.get(2 * n, 0) for n in nodes])
    at = np.zeros(len(rows), np.int64)
    go = np.arange(len(rows)) if splits else rows[:0]
    while len(go):
        here = at[go]
        at[go] = left[here] + (x[feature[here], rows[go]] > cut[here])
        go = go[feature[at[go]] >= 0]
    return np.array(nodes)[at]


def members(x: np.ndarray, w: np.ndarray, wanted: Mapping[int, Sequence[int]], grown: Grown) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tree, node and rows of each wanted node that has rows in a chunk."""
    for tree, nodes in wanted.items():
        rows = np.flatnonzero(w[tree])
        at = standing(x, rows, grown.get(tree, {}))
        order = np.argsort(at, kind="stable")
        ends = np.flatnonzero(np.diff(at[order])) + 1
        some = set(nodes)
        for part in np.split(order, ends) if len(order) else []:
            if (node := int(at[part[0]])) in some:
                yield tree, node, rows[part]


def node_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["tree", "node", "found"])


BLOBS = "tree int, node long, found binary"


def roots(state: DataFrame, features: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Rows and rows of class 1 of every tree that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, w in chunks(batches, features):
            n, p = w.sum(axis=1, dtype=np.int64), w @ y
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(p.astype(np.int64))], ["tree", "n", "p"])

    found = state.mapInArrow(run, "tree int, n long, p long").groupBy("tree").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return {(r["tree"], 1): (r["n"], r["p"]) for r in found.where("n > 0").collect()}  # a row a tree


def bin_values(state: DataFrame, features: int) -> list[np.ndarray]:
    """Up to ``BINS`` values of each feature, ascending."""
    probs = F.lit([float(q) for q in np.linspace(0, 1, BINS)])
    row = state.agg(*[F.percentile_approx(f"x{i}", probs, F.lit(ACCURACY)).alias(f"x{i}") for i in range(features)]).first()
    return [np.unique(np.array(row[f"x{i}"], float)) for i in range(features)]


def bin_codes(values: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """2 i + 1 for a value equal to part i, 2 i for one in the gap below it."""
    at = np.searchsorted(parts, values)
    return 2 * at + (parts[np.minimum(at, len(parts) - 1)] == values)


def split_level(
    state: DataFrame, open_: Mapping[tuple[int, int], tuple[int, int]], grown: Grown, parts: Sequence[np.ndarray], features: int, rule: Rule
) -> dict[tuple[int, int], tuple[int, float, float, int, int]]:
    """Feature, threshold, impurity, and rows and rows of class 1 on the left, of the best cut of every open node that has one."""
    width = 2 * BINS + 1
    wanted: dict[int, list[int]] = {}
    for tree, node in open_:
        wanted.setdefault(tree, []).append(node)
    some = {at: rule.candidates(*at, features) for at in open_}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w in chunks(batches, features):
            codes = [bin_codes(x[f], parts[f]) for f in range(features)]
            found = []
            for tree, node, rows in members(x, w, wanted, grown):
                copies, cells = w[tree][rows].astype(float), []
                for k, f in enumerate(some[tree, node]):
                    n = np.bincount(codes[f][rows], copies, width)
                    p = np.bincount(codes[f][rows], copies * y[rows], width)
                    full = np.flatnonzero(n)
                    cells.append(np.array([full + k * width, n[full], p[full]]))
                found.append((tree, node, np.concatenate(cells, axis=1).astype(np.int32).tobytes()))
            yield node_batch(found)

    def locate(group: pa.Table) -> pa.Table:
        """Bin of both places of every quantile, with the rows (all, of class 1) before it and in it, for each candidate."""
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        sums = np.zeros((2, len(some[tree, node]) * width), np.int64)
        for blob in group.column("found").to_pylist():
            at, n, p = np.frombuffer(blob, np.int32).reshape(3, -1)
            sums[0, at] += n
            sums[1, at] += p
        low, high, _ = places(open_[tree, node][0])
        out = []
        for n, p in zip(*sums.reshape(2, -1, width)):
            upto, ones = np.cumsum(n), np.cumsum(p)
            code = np.searchsorted(upto, np.concatenate([low, high]), side="right")
            out.append([code, upto[code] - n[code], ones[code] - p[code], n[code], p[code]])
        return pa.Table.from_batches([node_batch([(tree, node, np.array(out, np.int64).tobytes())])])

    counted = state.mapInArrow(count, BLOBS).groupBy("tree", "node").applyInArrow(locate, BLOBS)
    spots = {(r["tree"], r["node"]): np.frombuffer(r["found"], np.int64).reshape(-1, 5, 2 * len(CUTS)) for r in counted.collect()}  # 160 numbers a candidate
    kind = np.dtype([("k", "i2"), ("v", "f8"), ("w", "u1"), ("p", "u1")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w in chunks(batches, features):
            codes = [bin_codes(x[f], parts[f]) for f in range(features)]
            found = []
            for tree, node, rows in members(x, w, wanted, grown):
                values = []
                for k, f in enumerate(some[tree, node]):
                    gaps = np.zeros(width, bool)
                    gaps[spots[tree, node][k, 0]] = True
                    gaps[1::2] = False
                    mine = rows[gaps[codes[f][rows]]]
                    part = np.zeros(len(mine), kind)
                    part["k"], part["v"], part["w"], part["p"] = k, x[f][mine], w[tree][mine], w[tree][mine] * y[mine]
                    values.append(part.tobytes())
                found.append((tree, node, b"".join(values)))
            yield node_batch(found)

    def decide(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        n, ones = open_[tree, node]
        values = np.frombuffer(b"".join(group.column("found").to_pylist()), kind)
        _, _, share = places(n)
        ranks = np.concatenate(places(n)[:2])
        best = None
        for k, f in enumerate(some[tree, node]):
            code, before, ones_before, inside, ones_inside = spots[tree, node][k]
            mine = np.sort(values[values["k"] == k], order="v")
            v, upto, in_upto = mine["v"], np.cumsum(mine["w"], dtype=np.int64), np.cumsum(mine["p"], dtype=np.int64)
            held = bin_codes(v, parts[f])
            value, left, in_left = np.zeros(len(code)), before + inside, ones_before + ones_inside
            for i, c in enumerate(code):
                if c % 2:
                    value[i] = parts[f][c // 2]
                    continue
                first = np.searchsorted(held, c)
                skipped, in_skipped = (upto[first - 1], in_upto[first - 1]) if first else (0, 0)
                value[i] = v[np.searchsorted(upto, ranks[i] - before[i] + skipped, side="right")]
                last = np.searchsorted(v, value[i], side="right") - 1
                left[i], in_left[i] = before[i] + upto[last] - skipped, ones_before[i] + in_upto[last] - in_skipped
            m = len(CUTS)
            cuts = np.round(value[:m] + (value[m:] - value[:m]) * share, 9)
            upper = cuts >= value[m:]  # rows up to the cut: all up to its upper value, or those up to the lower one
            found = best_of(cuts, np.where(upper, left[m:], left[:m]), np.where(upper, in_left[m:], in_left[:m]), n, ones)
            if found and (best is None or found[1] < best[2]):
                best = (f, *found)
        rows = [] if best is None or best[2] >= gini(float(n), float(ones)) else [(tree, node, *best)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["tree", "node", "feature", "threshold", "score", "l", "lp"])

    chosen_ = state.mapInArrow(fetch, BLOBS).groupBy("tree", "node")
    best = chosen_.applyInArrow(decide, "tree int, node long, feature int, threshold double, score double, l long, lp long")
    return {(r[0], r[1]): tuple(r)[2:] for r in best.collect()}  # a row a node


def packed_kinds(state: DataFrame, features: int) -> list[str]:
    """The shortest NumPy type that holds each feature as it is."""
    x = [F.col(f"x{i}") for i in range(features)]
    row = state.agg(*[F.max(F.abs(c)).alias(f"m{i}") for i, c in enumerate(x)], *[F.bool_and(c == F.floor(c)).alias(f"i{i}") for i, c in enumerate(x)]).first()
    sizes = [(127, "i1"), (32_767, "i2"), (2**31 - 1, "i4")]
    return [next((k for most, k in sizes if row[f"i{i}"] and row[f"m{i}"] <= most), "f8") for i in range(features)]


def finish(state: DataFrame, small: Mapping[int, Sequence[int]], grown: Grown, kinds: Sequence[str], rule: Rule) -> DataFrame:
    """Grow the subtrees of the ``small`` nodes (by tree), each within a task."""
    names, d = [f.split()[0] for f in NODE_SCHEMA.split(", ")], len(kinds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w in chunks(batches, d):
            packed = [x[f].astype(k) for f, k in enumerate(kinds)]
            for tree, node, rows in members(x, w, small, grown):
                columns = [*(c[rows] for c in packed), y[rows].astype("u1"), w[tree][rows]]
                yield node_batch([(tree, node, b"".join(c.tobytes() for c in columns))])

    def run(group: pa.Table) -> pa.Table:
        all_kinds = [np.dtype(k) for k in (*kinds, "u1", "u1")]
        row_size = sum(k.itemsize for k in all_kinds)
        columns: list[list[np.ndarray]] = [[] for _ in all_kinds]
        for blob in group.column("found").to_pylist():
            n, start = len(blob) // row_size, 0
            for column, k in zip(columns, all_kinds):
                column.append(np.frombuffer(blob, k, n, start))
                start += n * k.itemsize
        *x, y, w = [np.concatenate(c) for c in columns]
        at = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        found = subtree(np.array([c.astype(float) for c in x]), y.astype(np.int64), w.astype(np.int64), *at, rule)
        types = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in found], k) for i, k in enumerate(types)], names=names)

    return state.mapInArrow(send, BLOBS).groupBy("tree", "node").applyInArrow(run, NODE_SCHEMA)


def grow(rows: DataFrame, features: int, rule: Rule, trees: int = 1, local: int = LOCAL) -> list[tuple]:
    """Node rows of all trees over ``x0.., y, w`` (a byte a tree: copies of the row in it)."""
    out: list[tuple] = []
    spark = rows.sparkSession
    ship_package(spark)
    with Stages(spark) as stages:
        state = stages.keep(rows.repartition(2 * spark.sparkContext.defaultParallelism), "tree-rows")
        sizes, small = roots(state, features), {}
        most = max((n for n, _ in sizes.values()), default=0)
        grown: dict[int, dict[int, tuple[int, float]]] = {}
        parts = bin_values(state, features) if most > local else []
        while sizes:
            for tree, node in (at for at, (n, _) in sizes.items() if n <= local):
                small.setdefault(tree, []).append(node)
            large = {at: s for at, s in sizes.items() if s[0] > local}
            open_ = {(t, k): (n, p) for (t, k), (n, p) in large.items() if k.bit_length() - 1 < rule.depth and n >= rule.least and 0 < p < n}
            splits = split_level(state, open_, grown, parts, features, rule) if open_ else {}
            sizes = {}
            for (tree, node), (n, p) in large.items():
                f, cut, score, left, in_left = splits.get((tree, node), (-1, None, None, 0, 0))
                out.append((tree, node, f, cut, int(2 * p >= n), n, float(gini(float(n), float(p))), score))
                if f >= 0:
                    grown.setdefault(tree, {})[node] = (f, cut)
                    sizes |= {(tree, 2 * node): (left, in_left), (tree, 2 * node + 1): (n - left, p - in_left)}
        turn, todo = max(1, TURN // max(1, most)), sorted(small)
        kinds = packed_kinds(state, features) if todo else []
        for i in range(0, len(todo), turn):
            out += [tuple(r) for r in finish(state, {t: small[t] for t in todo[i : i + turn]}, grown, kinds, rule).collect()]  # nodes, not rows
    return out


def settled(value: Column) -> Column:
    """Values and cuts at nine digits: equal averages must not fall on two sides of a cut because they were summed in another order."""
    return F.round(value, 9)


def prepared(df: DataFrame, features: Sequence[str], label: str, key: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``x0.., y`` with means for missing values; rows whose label is neither 0 nor 1 are left out."""
    means = fit_means(df, features)
    filled = impute(df.where(F.col(label).isin(0, 1)), means)
    columns = [settled(F.col(f)).alias(f"x{i}") for i, f in enumerate(features)]
    return filled.select(*([key] if key else []), *columns, F.col(label).cast("int").alias("y")), means


def fit_tree(df: DataFrame, features: Sequence[str], label: str = "label", rule: Rule = Rule(), local: int = LOCAL) -> TreeModel:
    rows, means = prepared(df, features, label)
    rows = rows.withColumn("w", F.lit(bytearray([1])))
    return TreeModel(list(features), means, grow(rows, len(features), rule, 1, local), 1, False)


def fit_forest(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", trees: int = 50, rule: Rule | None = None, local: int = LOCAL
) -> TreeModel:
    """Trees over bootstrap samples of the rows, each node on the root of the number of features."""
    rule = rule or Rule(take=max(1, math.isqrt(len(features))))
    rows, means = prepared(df, features, label, key)
    drawn = bootstrap_arrays(rows, key, trees, rule.seed, "w").drop(key)
    return TreeModel(list(features), means, grow(drawn, len(features), rule, trees, local), trees, True)
