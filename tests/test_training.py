"""Training step by step against plain versions of the definitions; large and small ways against each other."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.learning import boosting, gradient, minibatch, regression_boosting, trees
from tillwise.operators import bootstrap
from tillwise.operators.batches import batch_numbers
from tillwise.session import Stages, shared_folder
from tillwise.sources import model_store

NAMES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def table(spark):
    """Rows with ties, nulls, NaN, a constant column, and rows without a label."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        a, b, c = float(rng.integers(0, 12)), float(np.round(rng.normal(), 3)), float(rng.normal() * 50)
        label = int(a + 3 * b + rng.normal() > 6)
        rows.append([i, None if i % 17 == 0 else a, float("nan") if i % 23 == 0 else b, c, 2.0, label, a * b + c / 10])
    rows += [[400 + i, 1.0, 1.0, 1.0, 2.0, None, None] for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, same double, label int, y double").repartition(3)
    x = np.array([r[1:5] for r in rows[:400]], float)
    x = np.where(np.isnan(x), np.nanmean(np.array([r[1:5] for r in rows], float), axis=0), x)
    return df.where("id < 405"), x, np.array([r[5] for r in rows[:400]]), np.array([r[6] for r in rows[:400]])


def folders(spark):
    path = shared_folder(spark).removeprefix("file:")
    return set(os.listdir(path))


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_line_steps(spark, table, loss, tmp_path):
    df, x, y, _ = table
    fit = gradient.fit_logistic if loss == "logistic" else gradient.fit_hinge
    before = folders(spark)
    first = fit(df, NAMES, epochs=2)
    model_store.save(spark, first, f"{tmp_path}/m", NAMES)
    again, names = model_store.load(spark, f"{tmp_path}/m")
    assert again == first and names == NAMES
    model, whole = fit(df, NAMES, epochs=3, start=again), fit(df, NAMES, epochs=5)
    assert np.allclose([*model.weights, model.bias], [*whole.weights, whole.bias]) and model.steps == 5 and len(model.history) == 5
    scans = fit(df, NAMES, epochs=5, local=100)  # a scan per step
    assert np.allclose([*scans.weights, scans.bias], [*whole.weights, whole.bias]) and np.allclose(scans.history, whole.history)
    assert folders(spark) == before
    mean = np.array([whole.means[f] for f in NAMES])
    spread = np.array([whole.spreads[f] for f in NAMES])
    assert spread[3] == 1.0
    z = (x - mean) / spread
    w, b = np.zeros(4), 0.0
    cost = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for t in range(5):
        g = z @ w + b
        if loss == "logistic":
            pull, rate, more = 1 / (1 + np.exp(-g)) - y, 0.01, 0.0
        else:
            sign = 2 * y - 1
            pull, rate, more = np.where(sign * g < 1, -cost * sign, 0.0), 0.001 / np.sqrt(t + 1), w
        w, b = w - rate * (z.T @ pull / len(y) + more), b - rate * pull.mean()
    assert np.allclose(whole.weights, w) and whole.bias == pytest.approx(b)
    got = {r["id"]: r["prediction"] for r in whole.transform(df).collect()}
    assert [got[i] for i in range(400)] == [float(v >= 0) for v in z @ w + b]
    with pytest.raises(ValueError, match="other features"):
        fit(df, NAMES[:2], start=first)


def test_stumps_go_on(spark, table):
    df = table[0].where("label is not null")
    before = folders(spark)
    first = boosting.fit_stumps(df, NAMES[:3], "label", "id", rounds=2, lr=0.5)
    model = boosting.fit_stumps(df, NAMES[:3], "label", "id", rounds=2, lr=0.5, start=first)
    whole = boosting.fit_stumps(df, NAMES[:3], "label", "id", rounds=4, lr=0.5, fold_every=1)
    assert [(s.feature, s.threshold, s.polarity) for s in model.stumps] == [(s.feature, s.threshold, s.polarity) for s in whole.stumps]
    assert np.allclose([s.alpha for s in model.stumps], [s.alpha for s in whole.stumps])
    left = {f.split("-")[0] for f in folders(spark) - before}
    assert not left & {"boosting", "stumps"}


def test_resume_starts_anew_on_other_features(spark, table, tmp_path):
    fit = lambda names: lambda start: gradient.fit_logistic(table[0], names, epochs=1, start=start)
    path = f"{tmp_path}/m"
    assert model_store.resume(spark, path, NAMES, fit(NAMES)).steps == 1
    assert model_store.resume(spark, path, NAMES, fit(NAMES)).steps == 2
    assert model_store.resume(spark, path, NAMES[:2], fit(NAMES[:2])).steps == 1


def plain_tree(x, y, rule, tree=0, node=1):
    """The definition, cut by cut."""
    impurity = lambda v: 1.0 - (np.mean(v == 1) ** 2 + np.mean(v != 1) ** 2) if len(v) else 0.0
    best = None
    if node.bit_length() - 1 < rule.depth and len(y) >= rule.least and impurity(y) > 0:
        for f in rule.candidates(tree, node, x.shape[1]):
            for cut in np.unique(np.round(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16)), 9)):
                left = x[:, f] <= cut
                if 0 < left.sum() < len(y):
                    score = left.mean() * impurity(y[left]) + (~left).mean() * impurity(y[~left])
                    if best is None or score < best[0] - 1e-12:
                        best = (score, f, cut, left)
    if best is None or best[0] >= impurity(y) - 1e-12:
        return {node: (-1, int(2 * y.sum() >= len(y)), len(y))}
    _, f, cut, left = best
    found = {node: (f, round(cut, 6), len(y))}
    return found | plain_tree(x[left], y[left], rule, tree, 2 * node) | plain_tree(x[~left], y[~left], rule, tree, 2 * node + 1)


def test_tree_is_the_definition(table):
    df, x, y, _ = table
    model = trees.fit_tree(df, NAMES)
    got = {r[1]: (r[2], round(r[3], 6) if r[2] >= 0 else r[4], r[5]) for r in model.nodes}
    assert got == plain_tree(np.round(x, 9), y, trees.Rule()) and len(got) > 8
    share = sum(model.importances())
    assert share == pytest.approx(1.0) and sum(model.usage().values()) == sum(r[2] >= 0 for r in model.nodes)


def test_tree_in_levels_is_the_same(spark, table):
    df, x, y, _ = table
    before = folders(spark)
    small, large = (trees.fit_tree(df, NAMES, rule=trees.Rule(depth=3), local=k) for k in (5_000, 150))
    assert sorted(small.nodes) == sorted(large.nodes)
    assert not {f.split("-")[0] for f in folders(spark) - before} & {"tree"}


def test_forest(spark, table, tmp_path):
    df, x, y, _ = table
    rule = trees.Rule(depth=3, take=2)
    one, two = (trees.fit_forest(part, NAMES, "id", trees=4, rule=rule) for part in (df, df.repartition(7, "c")))
    assert sorted(one.nodes) == sorted(two.nodes)
    levels = trees.fit_forest(df, NAMES, "id", trees=2, rule=rule, local=200)
    assert sorted(levels.nodes) == sorted(r for r in one.nodes if r[0] < 2)
    model_store.save(spark, one, f"{tmp_path}/f", NAMES)
    again, _ = model_store.load(spark, f"{tmp_path}/f")
    votes = np.zeros(400)
    for t in range(4):
        nodes = {r[1]: r for r in one.nodes if r[0] == t}
        for i in range(400):
            k = 1
            while nodes[k][2] >= 0:
                k = 2 * k + int(round(x[i, nodes[k][2]], 9) > nodes[k][3])
            votes[i] += nodes[k][4] / 4
    got = {r["id"]: (r["score"], r["prediction"]) for r in again.transform(df).collect()}
    assert [got[i] for i in range(400)] == [(v, float(v >= 0.5)) for v in votes]


def test_forest_stores_a_row_once(spark, table, monkeypatch):
    """levels of large nodes read one stored table, a row an input row, however many trees and levels; few bins change nothing."""
    stored, keep = [], Stages.keep

    def counted(self, df, name="stage"):
        out = keep(self, df, name)
        stored.append((name, out.count()))
        return out

    rule = trees.Rule(depth=4, take=2)
    want = trees.fit_forest(table[0], NAMES, "id", trees=3, rule=rule)
    monkeypatch.setattr(Stages, "keep", counted)
    monkeypatch.setattr(trees, "BINS", 5)
    got = trees.fit_forest(table[0], NAMES, "id", trees=3, rule=rule, local=40)
    assert sorted(got.nodes) == sorted(want.nodes) and len(want.nodes) > 30
    assert stored == [("tree-rows", 400)]


def test_forest_takes_turns(table, monkeypatch):
    rule = trees.Rule(depth=3, take=2)
    want = trees.fit_forest(table[0], NAMES, "id", trees=3, rule=rule)
    monkeypatch.setattr(trees, "TURN", 500)  # a tree at a time
    assert sorted(trees.fit_forest(table[0], NAMES, "id", trees=3, rule=rule).nodes) == sorted(want.nodes)


def test_trees_without_a_choice(spark, table):
    alone = table[0].where("id = 3")
    (leaf,) = trees.fit_tree(alone, NAMES).nodes
    assert leaf[1:3] == (1, -1) and leaf[5] == 1
    pure = trees.fit_tree(table[0].where("label = 1"), NAMES)
    assert len(pure.nodes) == 1 and pure.nodes[0][4] == 1


def test_bootstrap(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    count = lambda df: Counter(map(tuple, df.select("k", "tree", "copies").collect()))
    drawn = count(bootstrap.bootstrap_counts(rows, "k", 3))
    assert drawn == count(bootstrap.bootstrap_counts(rows.repartition(9), "k", 3))
    share = Counter(c for (_, t, c), _ in drawn.items() if t == 0)
    assert abs(share[1] / 3000 - np.exp(-1)) < 0.03 and abs(sum(k * n for k, n in share.items()) / 3000 - 1) < 0.06
    odd = rows.select(F.when(F.col("k") % 9 > 0, F.col("k") % 50).alias("k")).withColumn("tree", F.lit(7))  # keys repeat, some are null
    bytes_ = bootstrap.bootstrap_arrays(odd.drop("tree"), "k", 4).collect()
    want = Counter(map(tuple, bootstrap.bootstrap_counts(odd, "k", 4).select("k", "tree", "copies").collect()))
    assert len(bytes_) == 3000 and want == Counter((r["k"], t, c) for r in bytes_ for t, c in enumerate(r["copies"]) if c)
    exact = count(bootstrap.exact_bootstrap(rows, "k", 3))
    assert all(sum(c for (_, t, c) in exact if t == s) == 3000 for s in range(3))
    assert exact == count(bootstrap.exact_bootstrap(rows.repartition(9), "k", 3))


def plain_boost(x, y, model, rounds, depth, lr):
    """Trees by the definition on the model's own cuts; squared error of every cut in turn."""
    rest = (y - y.mean()) / y.std()
    cuts = [np.unique(x[:, f]) if len(np.unique(x[:, f])) <= 300 else None for f in range(x.shape[1])]
    out = []
    for t in range(rounds):
        tree, value = {}, np.zeros(len(y))

        def grow(node, rows):
            best = None
            if node.bit_length() - 1 < depth and len(rows) >= 2:
                for f in trees.chosen(t, node, x.shape[1], 2, 42):
                    options = cuts[f] if cuts[f] is not None else sorted({c for tr in model.trees for g, c, _ in tr.values() if g == f})
                    for cut in options:
                        left = x[rows, f] < cut
                        if 0 < left.sum() < len(rows):
                            error = rest[rows][left].var() * left.sum() + rest[rows][~left].var() * (~left).sum()
                            if best is None or error < best[0] - 1e-9:
                                best = (error, f, cut, left)
            if best is None:
                tree[node] = (-1, None, rest[rows].mean())
                value[rows] = tree[node][2]
            else:
                tree[node] = (best[1], best[2], None)
                grow(2 * node, rows[best[3]])
                grow(2 * node + 1, rows[~best[3]])

        grow(1, np.arange(len(y)))
        rest = rest - lr * value
        out.append(tree)
    return out


def test_boosted_trees(spark, table, tmp_path):
    df, x, _, y = table
    before = folders(spark)
    small, large = (regression_boosting.fit_boosted(df, NAMES, "y", rounds=3, lr=0.3, depth=2, local=k) for k in (50_000, 10))
    assert not {f.split("-")[0] for f in folders(spark) - before} & {"boost"}
    for a, b in zip(small.trees, large.trees):
        assert {n: e[:2] for n, e in a.items()} == {n: e[:2] for n, e in b.items()}
        assert all(e[2] is None or e[2] == pytest.approx(b[n][2]) for n, e in a.items())
    assert small.history[-1] == pytest.approx(large.history[-1])
    want = plain_boost(np.round(x, 9), y, small, 3, 2, 0.3)
    for a, b in zip(small.trees, want):
        assert {n: e[0] for n, e in a.items()} == {n: e[0] for n, e in b.items()}
        assert all(np.isclose(e[1] or 0, b[n][1] or 0) and np.isclose(e[2] or 0, b[n][2] or 0) for n, e in a.items())
    model_store.save(spark, small, f"{tmp_path}/b", NAMES)
    again, _ = model_store.load(spark, f"{tmp_path}/b")
    got = {r["id"]: r["prediction"] for r in again.transform(df).collect()}
    rest = (y - np.array([got[i] for i in range(400)])) / y.std()
    assert np.mean(rest**2) == pytest.approx(small.history[-1])
    assert regression_boosting.fit_boosted(df.where("id < 0"), NAMES, "y").trees == []


def test_boosting_scans_blocks(table, monkeypatch):
    """F6 to F9: the state is packed blocks, not rows; no level of leaves is scanned; a scan reads the columns it needs only."""
    stored, scans, keep, level = [], [], Stages.keep, regression_boosting.level_splits

    def counted(self, df, name="stage"):
        out = keep(self, df, name)
        stored.append((name, out.count()))
        return out

    def scanned(state, tree, open_, plan):
        scans.append(len(open_))
        return level(state, tree, open_, plan)

    want = regression_boosting.fit_boosted(table[0], NAMES, "y", rounds=2, lr=0.3, depth=2)
    monkeypatch.setattr(Stages, "keep", counted)
    monkeypatch.setattr(regression_boosting, "level_splits", scanned)
    got = regression_boosting.fit_boosted(table[0], NAMES, "y", rounds=2, lr=0.3, depth=2, local=10)
    for a, b in zip(want.trees, got.trees, strict=True):
        assert {n: e[:2] for n, e in a.items()} == {n: e[:2] for n, e in b.items()}
        assert all(e[2] is None or e[2] == pytest.approx(b[n][2]) for n, e in a.items())
    assert scans == [1, 2, 1, 2]
    assert [n for name, n in stored if name == "boost-state"] and all(n <= 16 for name, n in stored if name == "boost-state")
    (root,) = regression_boosting.fit_boosted(table[0], NAMES, "y", rounds=1, depth=0, local=10).trees
    assert list(root) == [1] and root[1][2] == pytest.approx(0.0)


def test_batches(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    with Stages(spark) as stages:
        one, two = (
            {r["id"]: (r["pos"], r["batch"]) for r in batch_numbers(part, "id", 64, stages, 42).collect()} for part in (rows, rows.repartition(7))
        )
        twice = [tuple(r) for r in batch_numbers(rows.select(F.lit(1).alias("id"), "v"), "id", 300, stages).select("pos", "batch").collect()]
    assert one == two and sorted(p for p, _ in one.values()) == list(range(1000))
    assert Counter(b for _, b in one.values()) == Counter({**{i: 64 for i in range(15)}, 15: 40})
    assert sorted(twice) == [(i, i // 300) for i in range(1000)]


def test_polynomial_batches(spark, table, monkeypatch):
    """Products of maps equal the batches taken one by one, over two levels of products."""
    monkeypatch.setattr(minibatch, "FAN", 2)
    df, x, _, y = table
    first = minibatch.fit_polynomial(df, NAMES[:3], "id", "y", epochs=1, lr=0.01, batch=5)
    model = minibatch.fit_polynomial(df, NAMES[:3], "id", "y", epochs=1, lr=0.01, batch=5, start=first)
    x = x[:, :3].copy()  # means of the rows with a target
    x[::17, 0], x[::23, 1] = model.means["a"], model.means["b"]
    terms = minibatch.expand(x, 2)
    z, target = (terms - model.centers) / model.spreads, (y - y.mean()) / y.std()
    w, b, losses = np.zeros(9), 0.0, []
    with Stages(spark) as stages:
        for epoch in (0, 1):
            known = df.where("y is not null").select("id")
            order = {r["id"]: r["pos"] for r in batch_numbers(known, "id", 5, stages, 42 + epoch).collect()}
            turn, lost = sorted(order, key=order.get), 0.0
            for at in range(0, 400, 5):
                rows = turn[at : at + 5]
                error = z[rows] @ w + b - target[rows]
                lost += (error**2).sum()
                w, b = w - 0.01 * 2 / 5 * z[rows].T @ error, b - 0.01 * 2 / 5 * error.sum()
            losses.append(lost / 400)
    assert np.allclose(model.weights, w) and model.bias == pytest.approx(b) and np.allclose(model.history, losses) and model.steps == 2
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(400)], (z @ w + b) * y.std() + y.mean())
