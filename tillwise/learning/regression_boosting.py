"""Gradient-boosted regression trees on squared error, by histograms.

The target is standardised and every tree is fitted to what the earlier ones leave. Candidate cuts are fixed
once per feature, from its distinct values: all of them if there are at most 300, else 100 percentiles; a
row is then a list of small bin numbers, and a value below the cut goes left. A node takes the cut of least
squared error among its features, chosen by hash of round and node; it is a leaf at the depth limit,
with fewer than two rows, or where no cut parts its rows.

* **Large tables**: a level of a tree is one scan of the columns it needs. Each task adds up (rows, residuals) per node,
  feature and bin, for all nodes at once; a node's sums are added and its split is chosen after a shuffle of one row per
  task and node, so that one row a node reaches the driver. Leaves follow from their parents' sums. The residuals are
  written anew after every tree. The state is stored in blocks of neighbouring rows, a packed column a feature.
* **Tables of at most ``LOCAL`` rows** are boosted within one task on the same bins.

Both ways give the same trees, up to the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clean
from ..operators.sampling import in_share
from ..operators.scaling import fit_means, impute
from ..operators.stats import long_values
from ..session import Stages, ship_package
from .trees import chosen, settled

#: Up to so many distinct values are all cuts.
DISTINCT = 300
#: Else so many percentiles of the distinct values.
PERCENTILES = 100
#: Of the sketch behind the percentiles, which is exact up to so many distinct values.
ACCURACY = 100_000
#: Rows that one task may boost.
LOCAL = 50_000


@dataclass
class BoostModel:
    """Trees as node tables: ``node -> (feature, cut)`` or ``node -> value``; the children of k are 2k and 2k + 1."""

    features: list[str]
    means: dict[str, float]
    mean: float
    spread: float
    lr: float
    trees: list[dict[int, tuple]] = field(default_factory=list)  # (feature, cut, None) or (-1, None, value)
    history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        trees, lr, mean, spread = [arrays(t) for t in self.trees], self.lr, self.mean, self.spread

        @F.pandas_udf("double")
        def predicted(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(float) for c in batch])
                out = np.zeros(len(x))
                for tree in trees:
                    out += lr * leaf_values(tree, x)
                yield pd.Series(out * spread + mean)

        values = [settled(F.coalesce(clean(f), F.lit(self.means[f]))) for f in self.features]
        return df.withColumn("prediction", predicted(*values))

    def rows(self, spark) -> DataFrame:
        """``round, node, feature, cut, value``; leaf values on the standardised scale."""
        found = [
            (i + 1, node, self.features[f] if f >= 0 else None, cut, value)
            for i, tree in enumerate(self.trees)
            for node, (f, cut, value) in sorted(tree.items())
        ]
        return spark.createDataFrame(found, "round int, node long, feature string, cut double, value double")


def arrays(tree: dict[int, tuple]) -> tuple[np.ndarray, ...]:
    """Feature, cut, left child's place and value by place; children stand side by side."""
    nodes = sorted(tree)
    place = {n: i for i, n in enumerate(nodes)}
    column = lambda k, none: np.array([none if tree[n][k] is None else tree[n][k] for n in nodes])
    return column(0, -1), column(1, 0.0), np.array([place.get(2 * n, 0) for n in nodes]), column(2, 0.0)


def leaf_values(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, cut, left, value = tree
    at = np.zeros(len(x), np.int64)
    while True:
        go = np.flatnonzero(feature[at] >= 0)
        if not len(go):
            return value[at]
        f = feature[at[go]]
        at[go] = left[at[go]] + (x[go, f] >= cut[at[go]])


@dataclass(frozen=True)
class Plan:
    """What all rounds share."""

    cuts: list[list[float]]  # by feature
    depth: int
    take: int
    lr: float
    seed: int

    @property
    def bins(self) -> int:
        return max((len(c) for c in self.cuts), default=0) + 1

    def candidates(self, tree: int, node: int) -> list[int]:
        return chosen(tree, node, len(self.cuts), self.take, self.seed)


def best_split(rows: np.ndarray, total: np.ndarray, candidates: Sequence[int], plan: Plan) -> tuple[int, int] | None:
    """Feature and cut number of least squared error, from rows and residuals per (candidate, bin). Ties: first feature, lower cut."""
    best = None
    for k, f in enumerate(candidates):
        n, s = np.cumsum(rows[k])[: len(plan.cuts[f])], np.cumsum(total[k])[: len(plan.cuts[f])]
        all_n, all_s = rows[k].sum(), total[k].sum()
        keep = np.flatnonzero((n > 0) & (n < all_n))
        if not len(keep):
            continue
        n, s = n[keep], s[keep]
        explained = np.round(s * s / n + (all_s - s) ** 2 / (all_n - n), 9)  # what the squared error falls by, up to a constant
        j = int(np.argmax(explained))
        if best is None or explained[j] > best[2]:
            best = (f, int(keep[j]), explained[j])
    return best and best[:2]


def local_tree(bins: np.ndarray, y: np.ndarray, number: int, plan: Plan) -> tuple[dict[int, tuple], np.ndarray]:
    """A tree over rows in memory, and its value for every row."""
    tree: dict[int, tuple] = {}
    values = np.zeros(len(y))
    todo = [(1, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        mine, found = y[rows], None
        if node.bit_length() - 1 < plan.depth and len(rows) >= 2:
            some = plan.candidates(number, node)
            counts = [np.bincount(bins[rows, f], minlength=plan.bins) for f in some]
            sums = [np.bincount(bins[rows, f], weights=mine, minlength=plan.bins) for f in some]
            found = best_split(np.array(counts), np.array(sums), some, plan)
        if found is None:
            tree[node] = (-1, None, float(mine.mean()) if len(mine) else 0.0)
            values[rows] = tree[node][2]
            continue
        f, k = found
        tree[node] = (f, plan.cuts[f][k], None)
        right = bins[rows, f] > k
        todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return tree, values


def boost_local(state: DataFrame, plan: Plan, rounds: int) -> tuple[list[dict[int, tuple]], list[float]]:
    """All rounds over a bounded table, in one task."""
    d = len(plan.cuts)

    def run(group: pa.Table) -> pa.Table:
        bins = np.column_stack([unpacked(group.column(f"b{i}"), np.int16) for i in range(d)]).astype(np.int64)
        y = unpacked(group.column("y"), float)
        order = np.lexsort([y, *bins.T])  # an order of the rows' own, whatever the shuffle gave
        bins, rest = bins[order], y[order]
        out = []
        for t in range(rounds):
            tree, values = local_tree(bins, rest, t, plan)
            rest = rest - plan.lr * values
            out += [(t, node, f, cut, value, None) for node, (f, cut, value) in tree.items()]
            out.append((t, 0, -1, None, None, float(np.mean(rest**2))))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["t", "node", "f", "cut", "value", "loss"])

    found = state.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "t int, node long, f int, cut double, value double, loss double").collect()
    trees: list[dict[int, tuple]] = [{} for _ in range(rounds)]
    losses = [0.0] * rounds
    for t, node, f, cut, value, loss in found:
        if node:
            trees[t][node] = (f, cut, value)
        else:
            losses[t] = loss
    return trees, losses


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of packed rows at a time."""
    return (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def mean_square(state: DataFrame) -> float:
    """Mean squared residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            y = unpacked(block.column(0), float)
            yield pa.RecordBatch.from_arrays([pa.array([float(len(y))]), pa.array([float(y @ y)])], ["n", "s"])

    return state.select("y").mapInArrow(run, "n double, s double").agg(F.sum("s") / F.sum("n")).first()[0]


def level_splits(state: DataFrame, tree: dict[int, tuple], open_: dict[int, list[int]], plan: Plan) -> dict[int, tuple]:
    """Open node -> rows, residuals, and if it can be split feature, cut number, and rows and residuals on the left. One scan, a row a node out."""
    width, take = plan.bins, min(plan.take, len(plan.cuts))
    nodes = sorted(open_)
    grown = by_bins({**tree, **{node: (-1, None, float(i)) for i, node in enumerate(nodes)}, **closed(tree, open_)}, plan)
    used = sorted({f for f, _, _ in tree.values() if f >= 0} | {f for some in open_.values() for f in some})
    candidates = np.array([open_[n] for n in nodes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros((2, take, len(nodes) * width))
        for block in blocks(batches):
            y = unpacked(block.column(len(used)), float)
            bins = np.zeros((used[-1] + 1, len(y)), np.int16)
            for i, f in enumerate(used):
                bins[f] = unpacked(block.column(i), np.int16)
            at = leaf_values(grown, bins.T).astype(np.int64)
            rows = np.flatnonzero(at >= 0)
            at, rest = at[rows], y[rows]
            for k in range(take):
                cell = at * width + bins[candidates[at, k], rows]
                flat[0, k] += np.bincount(cell, minlength=flat.shape[2])
                flat[1, k] += np.bincount(cell, rest, flat.shape[2])
        sums = flat.reshape(2, take, len(nodes), width).transpose(2, 0, 1, 3)
        full = [i for i in range(len(nodes)) if sums[i, 0].any()]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in full], pa.int64()), pa.array([sums[i].tobytes() for i in full], pa.binary())], ["node", "sums"])

    def decide(group: pa.Table) -> pa.Table:
        node = group.column("node")[0].as_py()
        blobs = sorted(group.column("sums").to_pylist())  # an order of their own, whatever the shuffle gave
        rows, total = sum(np.frombuffer(b) for b in blobs).reshape(2, take, width)
        split = best_split(rows, total, open_[node], plan) if node.bit_length() - 1 < plan.depth else None
        f, cut, n, s = -1, None, None, None
        if split is not None:
            f, cut = split
            k = open_[node].index(f)
            n, s = float(rows[k, : cut + 1].sum()), float(total[k, : cut + 1].sum())
        found = [node, float(rows[0].sum()), float(total[0].sum()), f, cut, n, s]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table([pa.array([v], k) for v, k in zip(found, kinds)], names=["node", "n", "s", "f", "cut", "ln", "ls"])

    partial = state.select(*[f"b{f}" for f in used], "y").mapInArrow(run, "node long, sums binary")
    best = partial.groupBy("node").applyInArrow(decide, "node long, n double, s double, f int, cut int, ln double, ls double")
    return {r["node"]: tuple(r)[1:] for r in best.collect()}


def by_bins(tree: dict[int, tuple], plan: Plan) -> tuple[np.ndarray, ...]:
    """A tree that takes bin numbers in place of values."""
    turned = {n: (f, None if f < 0 else plan.cuts[f].index(cut) + 1, value) for n, (f, cut, value) in tree.items()}
    return arrays(turned)


def closed(tree: dict[int, tuple], open_: dict[int, list[int]]) -> dict[int, tuple]:
    """Finished leaves marked as no open node."""
    return {n: (-1, None, -1.0) for n, (f, _, _) in tree.items() if f < 0 and n not in open_}


def level_tree(state: DataFrame, number: int, plan: Plan) -> dict[int, tuple]:
    """A tree over a table of any size, a scan per level but the last, whose leaves are known from the splits above."""
    tree: dict[int, tuple] = {}
    open_ = {1: plan.candidates(number, 1)}
    while open_:
        below: dict[int, list[int]] = {}
        for node, (n, s, f, cut, left_n, left_s) in level_splits(state, tree, open_, plan).items():
            if f < 0:
                tree[node] = (-1, None, s / n)
                continue
            tree[node] = (f, plan.cuts[f][cut], None)
            for child, rows, total in ((2 * node, left_n, left_s), (2 * node + 1, n - left_n, s - left_s)):
                if child.bit_length() - 1 < plan.depth and rows >= 2:
                    below[child] = plan.candidates(number, child)
                else:
                    tree[child] = (-1, None, total / rows)
        open_ = below
    return tree


def folded(state: DataFrame, tree: dict[int, tuple], plan: Plan) -> DataFrame:
    """``state`` with a tree's values taken off the target."""
    done, lr, d = by_bins(tree, plan), plan.lr, len(plan.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            bins = np.column_stack([unpacked(block.column(i), np.int16) for i in range(d)])
            rest = unpacked(block.column(d), float) - lr * leaf_values(done, bins)
            yield pa.RecordBatch.from_arrays([*block.columns[:d], pa.array([rest.tobytes()])], block.schema.names)

    return state.mapInArrow(run, state.schema)


def feature_cuts(filled: DataFrame, features: Sequence[str], stages: Stages) -> list[list[float]]:
    """Cuts of each feature, ascending: its distinct values, or percentiles of them."""
    values = stages.keep(long_values(filled, features, "feature").select("feature", "value").distinct(), "boost-values")
    probs = F.lit([float(q) for q in np.linspace(0, 1, PERCENTILES)])
    many = F.percentile_approx("value", probs, F.lit(ACCURACY))
    some = stages.keep(values.groupBy("feature").agg(F.count("*").alias("n"), many.alias("cuts")), "boost-cuts")
    few = values.join(some.where(F.col("n") <= DISTINCT).select("feature"), "feature").groupBy("feature").agg(F.collect_list("value").alias("cuts"))
    rows = few.unionByName(some.where(F.col("n") > DISTINCT).select("feature", "cuts")).collect()  # 300 values a feature at most
    return [sorted({v for r in rows if r["feature"] == f for v in r["cuts"]}) for f in features]


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 50, lr: float = 0.1, depth: int = 6, take: int | None = None,
    share: float = 1.0, key: str | None = None, seed: int = 42, local: int = LOCAL,
) -> BoostModel:
    """Boosted trees; ``take`` features a node (the root of their number by default).

    ``share`` below one fits all trees to that share of the rows, by hash of ``key``. Rows without a label
    are left out; missing features are filled with their means.
    """
    features = list(features)
    ship_package(df.sparkSession)
    known = df.where(clean(label).isNotNull())
    if share < 1.0:
        known = known.where(in_share(key, share, seed))
    means = fit_means(known, features)
    with Stages(df.sparkSession) as stages, Stages(df.sparkSession) as states:
        filled = impute(known, means).select(*[settled(F.col(f)).alias(f) for f in features], clean(label).alias("_y"))
        filled = stages.keep(filled.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), "boost-rows")
        n, mean, spread = filled.agg(F.count("*"), F.avg("_y"), F.stddev_pop("_y")).first()
        model = BoostModel(features, means, mean or 0.0, spread or 1.0, lr)
        if not n:
            return model
        plan = Plan(feature_cuts(filled, features, stages), depth, take or max(1, int(len(features) ** 0.5)), lr, seed)
        state = states.keep(binned(filled, features, plan, model), "boost-state")
        if n <= local:
            model.trees, model.history = boost_local(state, plan, rounds)
            return model
        for t in range(rounds):
            tree = level_tree(state, t, plan)
            model.trees.append(tree)
            state = states.keep(folded(state, tree, plan), "boost-state")
            states.drop(but=1)
        model.history.append(mean_square(state))
    return model


def binned(filled: DataFrame, features: Sequence[str], plan: Plan, model: BoostModel) -> DataFrame:
    """``b0.., y``: how many cuts a value reaches, and the standardised target; a row a block, columns packed."""
    cuts, names = [np.array(c, float) for c in plan.cuts], [*[f"b{i}" for i in range(len(features))], "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(c, batch.column(i).to_numpy(), side="right").astype(np.int16) for i, c in enumerate(cuts)]
            found.append(batch.column(len(cuts)).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in found], names)

    y = ((F.col("_y") - model.mean) / model.spread).alias("y")
    return filled.select(*features, y).mapInArrow(run, ", ".join(f"{n} binary" for n in names))
