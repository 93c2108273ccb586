"""Training against explicit NumPy descent and boosting, model quality, persistence, metamorphic checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.learning import boosting, descent, evaluate, explain, scoring
from tillwise.learning.prep import expanded_width, oversample, polynomial_stages, prep_pipeline
from tillwise.learning.registry import FAMILIES, families
from tillwise.operators.sampling import split
from tillwise.session import materialize
from tillwise.sources import model_store

FEATURES = ["quantity", "unit_price", "days", "visits"]


@pytest.fixture(scope="module")
def table(spark):
    """600 customers whose sales are about quantity x price and who churn when inactive."""
    u = lambda salt: F.pmod(F.xxhash64("customer_id", F.lit(salt)), F.lit(1000003)) / 1000003.0
    rows = spark.range(600).withColumnRenamed("id", "customer_id").select(
        "customer_id",
        (1 + F.floor(u(1) * 10)).cast("double").alias("quantity"),
        (10 + u(2) * 90).alias("unit_price"),
        (u(3) * 365).alias("days"),
        F.when(u(4) < 0.05, F.lit(None)).otherwise(F.floor(u(4) * 40)).cast("double").alias("visits"),
        u(5).alias("noise"),
    )
    rows = rows.withColumn("total_sales", F.col("quantity") * F.col("unit_price") * (0.95 + 0.1 * F.col("noise")))
    churn = (F.col("days") / 365 - 0.2 * (F.coalesce("visits", F.lit(0)) / 40) + 0.2 * F.col("noise")) > 0.6
    return materialize(rows.withColumn("churned", churn.cast("int")), "test")


def labelled(table, label):
    return table.select("customer_id", *FEATURES, F.col(label).cast("double").alias("label"))


def explicit_descent(x, y, epochs, lr):
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    t = (y - y.mean()) / y.std()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        e = z @ w + b - t
        w, b = w - lr * 2 / len(y) * z.T @ e, b - lr * 2 / len(y) * e.sum()
    return w, z, t


def test_closed_form_equals_explicit_descent(table):
    pdf = table.toPandas()
    x, y = pdf[["quantity", "unit_price", "days"]].to_numpy(), pdf.total_sales.to_numpy()
    model = descent.fit_multiple(table, ["quantity", "unit_price", "days"], "total_sales")
    w, z, t = explicit_descent(x, y, 150, 1e-4)
    want = y.mean() + y.std() * (z @ w)
    got = model.transform(table).orderBy("customer_id").toPandas().prediction
    assert np.allclose(got, want[np.argsort(pdf.customer_id)], rtol=1e-9)
    assert len(model.history) == 150 and model.history[0] == pytest.approx(1.0)

    simple = descent.fit_simple(table, ["unit_price", "quantity", "days"], "total_sales")
    best = simple.features[0]
    w, z, t = explicit_descent(pdf[[best]].to_numpy(), y, 150, 0.001)
    want = y.mean() + y.std() * (z @ w)
    got = simple.transform(table).orderBy("customer_id").toPandas().prediction
    assert np.allclose(got, want[np.argsort(pdf.customer_id)], rtol=1e-9)


def test_constant_feature_keeps_weight_zero(table):
    model = descent.fit_multiple(table.withColumn("constant", F.lit(4.0)), ["quantity", "constant"], "total_sales")
    assert model.weights[1] == 0.0 and model.weights[0] > 0


def explicit_boosting(x, y, rounds, lr):
    sign = np.where(y == 1, 1, -1)
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    out = []
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for thr in np.unique(np.quantile(x[:, j], boosting.CUTS)):
                pred = np.where(x[:, j] < thr, -1, 1)
                for polarity in (1, -1):
                    err = w[polarity * pred != sign].sum()
                    if best is None or err < best[0] - 1e-12:
                        best = (err, j, thr, polarity, polarity * pred)
        err, j, thr, polarity, pred = best
        alpha = 0.5 * np.log((1 - err) / err) * lr
        w = w * np.exp(-alpha * sign * pred)
        w = w / w.sum()
        out.append((j, thr, polarity, alpha))
    return out


def test_stumps_equal_explicit_boosting(table):
    names = ["quantity", "unit_price", "days"]
    train, _ = split(table, "customer_id", 0.15)
    pdf = train.toPandas()
    want = explicit_boosting(pdf[names].to_numpy(), pdf.churned.to_numpy(), 6, 0.5)
    model = boosting.fit_stumps(table, names, "churned", "customer_id", rounds=6, lr=0.5, fold_every=4)
    assert len(model.stumps) == 6
    for s, (j, thr, polarity, alpha) in zip(model.stumps, want):
        assert (s.feature, s.polarity) == (names[j], polarity)
        assert s.threshold == pytest.approx(thr) and s.alpha == pytest.approx(alpha)


def test_first_round_table_agrees_with_the_driver_choice(table):
    names = ["quantity", "unit_price", "days"]
    errors = boosting.first_round(table, names, "churned").collect()
    best = min(errors, key=lambda r: r["error"])
    pdf = table.toPandas()
    j, thr, polarity, _ = explicit_boosting(pdf[names].to_numpy(), pdf.churned.to_numpy(), 1, 0.5)[0]
    assert (best["feature"], best["polarity"]) == (names[j], polarity) and best["threshold"] == pytest.approx(thr)
    assert len(errors) == 2 * sum(len(v) for v in boosting.quantile_thresholds(table, names).values())


QUALITY = {
    "logistic_regression_classification": 0.85, "decision_tree_classification": 0.8,
    "random_forest_classification": 0.8, "svm_classification": 0.75, "mlp_classification": 0.75,
    "perceptron_classification": 0.75, "svm_pca_classification": 0.75,
}


@pytest.fixture(scope="module")
def fitted(table):
    """The cheap families, trained once."""
    models = {}
    for task, label in (("classification", "churned"), ("regression", "total_sales")):
        train, _ = split(labelled(table, label), "customer_id", 0.2)
        chosen = [f for f in families(task) if f.name in QUALITY or f.name in ("kmeans_classification", "hierarchical_classification", "least_squares_regression", "polynomial_regression", "linear_regression")]
        done, failed = evaluate.train_all(train, FEATURES, "customer_id", chosen)
        assert failed == {}
        models.update(done)
    return models


def test_quality_of_classifiers(table, fitted):
    _, test = split(labelled(table, "churned"), "customer_id", 0.2)
    chosen = {n: m for n, m in fitted.items() if FAMILIES[n].task == "classification"}
    results = evaluate.classification_results(evaluate.predictions(chosen, test, "customer_id")).collect()
    f1 = {r["model"]: r["f1_score"] for r in results}
    for name, least in QUALITY.items():
        assert f1[FAMILIES[name].title] > least, name
    assert len(f1) == len(chosen)


def test_quality_of_regressors(table, fitted):
    _, test = split(labelled(table, "total_sales"), "customer_id", 0.2)
    chosen = {n: m for n, m in fitted.items() if FAMILIES[n].task == "regression"}
    r2 = {r["model"]: r["r2"] for r in evaluate.regression_results(evaluate.predictions(chosen, test, "customer_id")).collect()}
    assert r2["Polynomial Regression (scratch)"] > 0.95 > r2["Multiple Regression (closed form)"] > 0.7
    assert 0.05 < r2["Linear Regression (scratch)"] < 0.5  # an unfinished descent by design


def test_metamorphic_directions(spark, table, fitted):
    row = table.where("visits is not null").limit(1)
    at = lambda m, **v: m.transform(row.withColumns({k: F.lit(float(x)) for k, x in v.items()})).first()
    churn = fitted["logistic_regression_classification"]
    p = [at(churn, days=d)["score"] for d in (5, 100, 365)]
    assert p == sorted(p) and p[0] < p[2]
    engaged = [at(churn, visits=v)["score"] for v in (0, 20, 40)]
    assert engaged == sorted(engaged, reverse=True)
    sales = fitted["polynomial_regression"]
    assert at(sales, quantity=2)["prediction"] < at(sales, quantity=9)["prediction"]


def test_failed_family_becomes_a_status_row(spark, table):
    from tillwise.learning.registry import Family

    def broken(df, features, key):
        raise RuntimeError("no such solver")

    train, test = split(labelled(table, "churned"), "customer_id", 0.2)
    models, failures = evaluate.train_all(
        train, FEATURES, "customer_id", [FAMILIES["decision_tree_classification"], Family("x", "X", "classification", broken)]
    )
    results = evaluate.with_failures(evaluate.classification_results(evaluate.predictions(models, test, "customer_id")), failures)
    status = {r["model"]: r["status"] for r in results.collect()}
    assert status == {"Decision Tree (scratch)": "OK", "x": "RuntimeError: no such solver"}


def test_models_survive_saving(spark, table, fitted, tmp_path):
    stumps = boosting.fit_stumps(table.withColumnRenamed("churned", "label"), FEATURES, "label", "customer_id", rounds=3, lr=0.5)
    for name in ("kmeans_classification", "mlp_classification", "linear_regression", "decision_tree_classification"):
        model_store.save(spark, fitted[name], str(tmp_path / name), FEATURES)
        again, names = model_store.load(spark, str(tmp_path / name))
        assert names == FEATURES
        data = labelled(table, "churned")
        a = fitted[name].transform(data).select("customer_id", F.col("prediction").alias("a"))
        b = again.transform(data).select("customer_id", F.col("prediction").alias("b"))
        assert a.join(b, "customer_id").where("abs(a - b) > 1e-9").count() == 0
    model_store.save(spark, stumps, str(tmp_path / "stumps.pkl"), FEATURES)
    again, _ = model_store.load_named(spark, str(tmp_path), "stumps")
    assert again == stumps
    with pytest.raises(FileNotFoundError):
        model_store.load_named(spark, str(tmp_path), "absent")


def test_load_or_fit_trains_once(spark, table, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return descent.fit_simple(table, FEATURES, "total_sales")

    path = str(tmp_path / "m")
    first = model_store.load_or_fit(spark, path, FEATURES, fit)
    second = model_store.load_or_fit(spark, path, FEATURES, fit)
    assert len(calls) == 1 and first.weights == second.weights


def test_scoring_labels_and_unknown_probability(table, fitted):
    rows = scoring.score(fitted["svm_classification"], labelled(table, "churned"), ["customer_id"]).collect()
    assert {r["probability"] for r in rows} == {0.5}
    assert all(r["label_text"] == ("Churn" if r["prediction"] else "Retain") for r in rows)


def test_churn_model_order(table, fitted):
    base = table.select("customer_id", *FEATURES, "total_sales")
    by_model = scoring.churn_scored(base, fitted)
    assert by_model.columns == [*base.columns, "churn_probability"]
    assert by_model.select("churn_probability").distinct().count() > 100
    by_rule = scoring.churn_scored(base, {})
    assert {r[0] for r in by_rule.select("churn_probability").distinct().collect()} <= {0.2, 0.5, 0.8}


def test_explanations(spark, table, fitted, tmp_path):
    ranked = explain.importance(spark, fitted["random_forest_classification"], FEATURES).collect()
    assert next(r for r in ranked if r["rank"] == 1)["feature"] == "days"
    weights = explain.top_weights(spark, fitted["least_squares_regression"], FEATURES, 2)
    assert {r["feature"] for r in weights.collect()} == {"quantity", "unit_price"}
    with pytest.raises(ValueError):
        explain.importance(spark, fitted["polynomial_regression"], FEATURES)
    usage = {r["feature"]: r["splits"] for r in explain.tree_usage(spark, fitted["decision_tree_classification"]).collect()}
    assert usage["days"] >= 1 and set(usage) <= set(FEATURES)
    rows = explain.linear_attributions(table, {"quantity": 2.0, "days": -1.0}, ["customer_id"])
    sums = rows.groupBy("feature").agg(F.sum("contribution").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-6 for r in sums)
    assert explain.loss_history(spark, fitted["logistic_regression_classification"]).count() > 1
    assert explain.loss_history(spark, fitted["linear_regression"]).count() == 150


def test_split_usage_of_a_saved_forest(spark, table, tmp_path):
    from tillwise.learning.registry import forest_pca

    model, path = forest_pca(labelled(table, "churned"), FEATURES, "customer_id"), str(tmp_path / "forest")
    model.stages[-1].write().save(path)
    usage = {r["feature"]: r["splits"] for r in explain.split_usage(spark, path, FEATURES).collect()}
    assert len(usage) >= 2 and sum(usage.values()) == model.stages[-1].toDebugString.count("If (")


def test_prep(spark, table):
    data = labelled(table, "churned")
    out = prep_pipeline(FEATURES).fit(data).transform(data)
    assert out.where("visits is null").count() > 0 and len(out.first()["features"]) == 4
    assert expanded_width(43, 2) == 989
    assert len(polynomial_stages([f"f{i}" for i in range(120)])) == len(polynomial_stages(FEATURES))  # no width is refused
    before = data.groupBy("label").count().collect()
    after = {r["label"]: r["count"] for r in oversample(data, "customer_id").groupBy("label").count().collect()}
    assert after[0.0] == next(r["count"] for r in before if r["label"] == 0.0)
    assert after[1.0] == pytest.approx(after[0.0], rel=0.15)
