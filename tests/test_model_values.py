"""The model queries' own values, against a second computation of each."""

import numpy as np
import pytest

from tillwise.learning.registry import FAMILIES
from tillwise.operators import whatif
from tillwise.plans import model_queries as mq


def by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_every_checked_query_has_its_values():
    flags = {"is_class", "finite", "is_part", "is_share", "in_order", "accuracy_agrees", "mae_below_rmse"}
    checked = {n for n, sql in mq.ORACLES.items() if any(f"AS {f}" in sql for f in flags)}
    assert checked == {n.removesuffix("_values") for n in mq.VALUES} and not set(mq.VALUES) & set(mq.ORACLES)


@pytest.fixture(scope="module")
def sales(spark, sf):
    """Features of the test customers, mean-filled from the training rows, and the least-squares weights."""
    train, test = mq.train_test(spark, sf, "regression")
    train, test = train.toPandas(), test.toPandas()
    mean = train[mq.FEATURES].mean()
    x = np.column_stack([np.ones(len(train)), train[mq.FEATURES].fillna(mean)])
    return test, mean, np.linalg.lstsq(x, train.label, rcond=None)[0]


def test_least_squares_scores(spark, sf, sales):
    test, mean, w = sales
    want = w[0] + test[mq.FEATURES].fillna(mean).to_numpy() @ w[1:]
    got = by(mq.QUERIES["score_least_squares_regression_values"](spark, sf).collect(), "customer_id")
    assert len(got) == len(test)
    assert np.allclose([got[(c,)]["prediction"] for c in test.customer_id], want, rtol=1e-4, atol=0.1)


def test_model_impacts(spark, sf, sales):
    test, _, w = sales
    got = by(mq.QUERIES["what_if_model_values"](spark, sf).collect(), "customer_id", "feature")
    moved = ["quantity", "unit_price", "discount_applied"]
    assert len(got) == len(test) * len(moved)
    for f in moved:
        x, weight = test[f], w[1 + mq.FEATURES.index(f)]
        steps = [(x + k * x.std()).clip(x.min(), x.max()) for k, _ in whatif.STEPS]
        i = np.abs(weight * np.array([(s - x).fillna(0) for s in steps]))
        for name, want in (("max_impact", i.max(0)), ("avg_impact", i.mean(0)), ("sensitivity", i.max(0) - i.min(0))):
            assert np.allclose([got[(c, f)][name] for c in test.customer_id], want, rtol=1e-3, atol=0.1), (f, name)


def test_evaluations_recount_the_scores(spark, sf):
    found = by(mq.QUERIES["evaluate_classification_values"](spark, sf).collect(), "model")
    family = FAMILIES["decision_tree_classification"]
    rows = mq.QUERIES[f"score_{family.name}"](spark, sf).collect()
    n = {(y, p): sum((r["label"], r["prediction"]) == (y, p) for r in rows) for y in (0, 1) for p in (0, 1)}
    got = found[(family.title,)]
    assert got["confusion_matrix"].asDict() == {"TN": n[0, 0], "FP": n[0, 1], "FN": n[1, 0], "TP": n[1, 1]}
    assert got["accuracy"] == pytest.approx((n[0, 0] + n[1, 1]) / len(rows))
    assert got["f1_score"] == pytest.approx(2 * n[1, 1] / max(1, 2 * n[1, 1] + n[0, 1] + n[1, 0]))
    found = by(mq.QUERIES["evaluate_regression_values"](spark, sf).collect(), "model")
    family = FAMILIES["least_squares_regression"]
    rows = mq.QUERIES[f"score_{family.name}_values"](spark, sf).collect()
    y, p = (np.array([r[c] for r in rows]) for c in ("label", "prediction"))
    got = found[(family.title,)]
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean())) and got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
