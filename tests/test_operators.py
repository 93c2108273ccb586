"""Hand-computed edge cases: ties, empty groups, zero denominators, nulls, constants."""

import math

import pytest
from pyspark.sql import functions as F

from tillwise.operators import correlation, curves, encoders, evaluation, features, insights, projection, quality, scaling, stats
from tillwise.session import materialize


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- encoders and projection -------------------------------------------------

def test_one_hot_drops_first_level_and_zeroes_null(spark):
    df = frame(spark, [("b", "x"), ("a", "x"), (None, "x"), ("c", "x")], "k string, single string")
    levels = encoders.fit_levels(df, ["k", "single"])
    assert levels == {"k": ["a", "b", "c"], "single": ["x"]}
    out = encoders.one_hot(df, levels)
    assert out.columns == ["k_b", "k_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    unseen = encoders.one_hot(frame(spark, [("z", "x")], "k string, single string"), levels).first()
    assert tuple(unseen) == (0, 0)


def test_one_hot_refuses_too_many_levels(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        encoders.fit_levels(df, ["k"], max_levels=10)


def test_yes_no_map_leaves_numbers_alone(spark):
    df = frame(spark, [("Yes", 1), ("No", 0), ("maybe", 1), (None, 0)], "loyalty_program string, churned int")
    rows = encoders.map_yes_no(df).collect()
    assert [r["loyalty_program"] for r in rows] == [1, 0, None, None]
    assert [r["churned"] for r in rows] == [1, 0, 1, 0]


def test_projection_helpers(spark):
    df = frame(spark, [(1, 2.0, "x", True)], "customer_id long, total_sales double, city string, flag boolean")
    assert projection.drop_ids(df).columns == ["total_sales", "city", "flag"]
    assert projection.drop_targets(df).columns == ["customer_id", "city", "flag"]
    assert projection.numeric_columns(df) == ["customer_id", "total_sales"]
    assert projection.analysis_columns(df) == ["total_sales"]
    assert projection.present(df, ["city", "nope"]) == ["city"]
    assert projection.feature_columns(df) == ["customer_id", "city", "flag"]
    assert projection.names_with_prefix(["a_x", "b", "a_k", "a_x"], "a_") == ["k", "x"]
    assert projection.customer_filter(df) is df


def test_align_features_orders_fills_and_drops(spark):
    df = frame(spark, [(1, None, 3)], "b int, a double, extra int")
    out = projection.align_features(df, ["a", "missing", "b"])
    assert out.columns == ["a", "missing", "b"] and tuple(out.first()) == (0.0, 0.0, 1.0)


def test_feature_resolution_order():
    known = features.MODEL_FEATURES
    assert len(known) == 43
    assert projection.resolve_features(["x"], 43, ["y"], known) == ["x"]
    assert projection.resolve_features(None, 43, ["y"], known) == known
    assert projection.resolve_features(None, 7, ["y"], known) == ["y"]


# ---- features ------------------------------------------------------------------

def test_request_scenarios(spark):
    base = "app_usage_frequency string, social_media_engagement string, email_subscriptions int, days_since_last_purchase int"
    df = frame(spark, [("Low", "Low", 0, 300), ("High", "High", 1, 5)], base)
    low, high = df.select(
        features.engagement_serving(df).alias("e"), features.recency_ratio(df).alias("r"),
        features.recency_score("days_since_last_purchase").alias("s"),
    ).collect()
    assert (low["e"], high["e"]) == (0.0, 0.75)
    assert low["r"] > high["r"] and low["s"] < high["s"]


def test_quantity_and_discount_scenarios(spark):
    df = frame(spark, [(2, 50.0, 0.0), (100, 50.0, 0.0), (100, 50.0, 0.5)], "quantity int, unit_price double, discount_applied double")
    values = [r["v"] for r in df.select(features.quantity_times_price(df, discounted=True).alias("v")).collect()]
    assert values == [100.0, 5000.0, 2500.0]


def test_online_scenarios(spark):
    df = frame(spark, [(10, 0), (0, 10), (0, 0)], "online_purchases int, in_store_purchases int")
    rows = df.select(features.online_preference(df).alias("p"), features.engagement_ratio(df).alias("r")).collect()
    assert [r["p"] for r in rows] == [pytest.approx(10 / 11), 0.0, 0.0]
    assert [r["r"] for r in rows] == [1.0, 0.0, 0.0]


def test_request_features_fill_defaults(spark):
    df = frame(spark, [(1, 45.0, 50, 1, 0)], "request_id int, age double, num_purchases int, is_active_member int, has_complained int")
    row = features.request_features(df).first()
    assert len(row) == 44
    assert row["age"] == 45.0 and row["total_transactions"] == 50.0 and row["loyalty_program"] == 1.0
    assert row["customer_support_calls"] == 2.0  # zero counts as missing
    assert row["unit_price"] == 100.0
    assert row["engagement_score"] == 0.25


def test_noise_is_keyed_and_has_the_right_spread(spark):
    df = spark.range(20000).select("id", features.gaussian("id", 42, 1.0, 0.02).alias("g"))
    again = df.repartition(7).select("id", features.gaussian("id", 42, 1.0, 0.02).alias("h"))
    assert df.join(again, "id").where("g <> h").count() == 0
    row = df.agg(F.avg("g"), F.stddev("g")).first()
    assert row[0] == pytest.approx(1.0, abs=1e-3) and row[1] == pytest.approx(0.02, rel=0.05)


# ---- scaling -------------------------------------------------------------------

def test_imputation_and_scaling(spark):
    df = frame(spark, [(1.0, 5.0, None), (float("nan"), 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    rows = scaling.mean_impute(df, ["a", "c"]).collect()
    assert [r["a"] for r in rows] == [1.0, 2.0, 3.0] and [r["c"] for r in rows] == [0.0] * 3
    z = scaling.zscore(scaling.mean_impute(df, ["a"]), ["a", "b"]).collect()
    assert [r["b"] for r in z] == [0.0] * 3
    assert z[2]["a"] == pytest.approx(1 / math.sqrt(2 / 3))
    fitted = scaling.fit_means(df, ["a", "c"])
    assert fitted == {"a": 2.0, "c": 0.0}


def test_fill_values(spark):
    df = frame(spark, [(1.0,), (1.0,), (2.0,), (9.0,), (None,)], "a double")
    assert scaling.fit_fill_values(df, ["a"], "median") == {"a": 1.5}
    assert scaling.fit_fill_values(df, ["a"], "mode") == {"a": 1.0}


def test_polynomial_order(spark):
    df = frame(spark, [(2, 3)], "x int, y int")
    out = scaling.polynomial_expand(df, ["x", "y"], 2)
    assert out.columns == ["x", "y", "x*x", "x*y", "y*y"] and tuple(out.first()) == (2, 3, 4, 6, 9)


# ---- statistics ----------------------------------------------------------------

def test_null_warning_limit(spark):
    rows = [(None if i < 500 else 1, None if i < 501 else 1, 1, None) for i in range(10000)]
    df = frame(spark, rows, "exact int, above int, full int, empty int")
    got = {r["column"]: (r["null_pct"], r["severity"]) for r in quality.null_findings(df, []).collect()}
    assert got == {"exact": (5.0, "ok"), "above": (5.01, "warning"), "full": (0.0, "ok"), "empty": (100.0, "warning")}


def test_correlation_edge_cases(spark):
    rows = [(float(i), 2.0 * i, 3.0, None if i % 2 else -float(i)) for i in range(10)]
    df = frame(spark, rows, "y double, x double, constant double, holes double")
    got = {r["feature"]: r["correlation"] for r in correlation.target_correlations(df, ["x", "constant", "holes"], "y").collect()}
    assert set(got) == {"x", "holes"} and got["x"] == pytest.approx(1) and got["holes"] == pytest.approx(-1)
    assert scaling.best_feature(df, ["constant", "x"], "y").first()["feature"] == "x"


def test_correlation_is_pairwise_complete_at_every_width(spark):
    """Nulls, NaN and constants in 30 columns, against pandas."""
    import pandas as pd

    hole = lambda k: (F.col("id") * (k + 3)) % 11 == 0
    value = lambda k: F.when(~hole(k), F.sin(F.col("id") * (k + 1)) + 1000)
    columns = [F.when(hole(k + 1), F.lit(float("nan"))).otherwise(value(k)).alias(f"c{k}") for k in range(29)]
    df = spark.range(200).select(*columns, F.lit(4.1).alias("constant"))
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in correlation.correlation_pairs(df, df.columns).collect()}
    want = pd.DataFrame([r.asDict() for r in df.collect()], dtype=float).corr()
    assert len(got) == 30 * 29 // 2
    for (a, b), r in got.items():
        undefined = "constant" in (a, b) or math.isnan(want.loc[a, b])  # an empty column is undefined as well
        assert r is None if undefined else r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_infinite_values_leave_other_pairs_alone(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.0, 1.0), (3.0, 7.0, 2.0)], "a double, b double, c double")
    got = {(r["i"], r["j"]): r["correlation"] for r in correlation.correlation_pairs(df, df.columns).collect()}
    assert got[0, 1] == pytest.approx(0.9933992677987828) and got[0, 2] is None and got[1, 2] is None


def test_missing_values_stay_missing(spark):
    from tillwise.functions.numeric import clip, relu, sigmoid

    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    rows = df.select(clip("x", 0, 1), relu("x"), sigmoid("x")).collect()
    assert tuple(rows[0]) == (None, None, None) and tuple(rows[1])[:2] == (0.0, 0.0) and tuple(rows[2])[:2] == (1.0, 2.0)


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, None), (300.0, "b")], "age double, label string")
    assert stats.null_profile(df).where("column = 'age'").first()["null_count"] == 2
    found = quality.range_findings(df, [quality.RangeRule("age", 0.0, 120.0)]).first()
    assert found["violations"] == 1
    assert quality.imbalance(df, "label").first()["minority_share"] == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    "t, dof, p",
    [(2.228138852, 10, 0.05), (0.0, 5, 1.0), (12.70620474, 1, 0.05), (3.2905267, 1e6, 0.001), (1.959963985, 1e7, 0.05), (1.959963985, 1e11, 0.05), (1.984, 99_999, 0.047258), (1.984, 100_001, 0.047258)],
)
def test_p_values(t, dof, p):
    assert correlation.two_sided_p(t, dof) == pytest.approx(p, rel=1e-4)


def test_levels_are_limited(spark):
    df = spark.range(100).select(F.format_string("%03d", "id").alias("k"))
    rows = stats.level_info(df, ["k"], limit=5).collect()
    assert [r["level"] for r in sorted(rows, key=lambda r: r["position"])] == ["000", "001", "002", "003", "004"]


# ---- evaluation ----------------------------------------------------------------

def labelled(spark, pairs):
    return frame(spark, [("m", y, p) for y, p in pairs], "model string, label int, prediction double")


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(1, 0.0), (0, 0.0)], (0.5, 0.0, 0.0, 0.0)),  # nothing predicted positive
        ([(0, 1.0), (0, 0.0)], (0.5, 0.0, 0.0, 0.0)),  # no positives
        ([(1, 1.0), (0, 0.0)], (1.0, 1.0, 1.0, 1.0)),
    ],
)
def test_class_metrics(spark, pairs, want):
    row = evaluation.class_metrics(evaluation.confusion(labelled(spark, pairs))).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == want


# Published hold-out confusion matrices (TN, FP, FN, TP) and their metrics.
PUBLISHED = [
    ("logistic", 132053, 20472, 12891, 34584, 0.8332, 0.6282, 0.7285, 0.6746),
    ("tree", 140140, 12385, 19367, 28108, 0.8412, 0.6941, 0.5921, 0.6391),
    ("forest", 140083, 12442, 18930, 28545, 0.8431, 0.6964, 0.6013, 0.6454),
    ("svm", 108607, 43918, 4585, 42890, 0.7575, 0.4941, 0.9034, 0.6388),
    ("kmeans", 116824, 35701, 36102, 11373, 0.6410, 0.2416, 0.2396, 0.2406),
    ("stumps", 128505, 24020, 11076, 36399, 0.8245, 0.6024, 0.7667, 0.6747),
]


def test_published_metrics_follow_from_their_matrices(spark):
    counts = frame(spark, [r[:5] for r in PUBLISHED], "model string, tn long, fp long, fn long, tp long")
    got = {r["model"]: r for r in evaluation.class_metrics(counts).collect()}
    for name, *_, acc, prec, rec, f1 in PUBLISHED:
        row = got[name]
        assert [round(row[m], 4) for m in ("accuracy", "precision", "recall", "f1_score")] == [acc, prec, rec, f1]


def test_regression_edge_cases(spark):
    constant = evaluation.regression_metrics(labelled(spark, [(2, 1.0), (2, 3.0)])).first()
    assert constant["r2"] == 0.0 and constant["rmse"] == 1.0
    masked = evaluation.regression_metrics(labelled(spark, [(0, 1.0), (-1, 1.0), (2, 1.0)])).first()
    assert masked["mape"] == 50.0 and masked["mape_unmasked"] == pytest.approx((200 + 50) / 2)


def test_histogram_edges(spark):
    df = frame(spark, [(v,) for v in [0.0, 1.0, 2.0, 3.0]], "v double")
    bins = {r["bin"]: r["count"] for r in evaluation.histogram(df, F.col("v"), bins=3).collect()}
    assert bins == {0: 1, 1: 1, 2: 2}  # the maximum falls into the last bin
    same = evaluation.histogram(frame(spark, [(5.0,), (5.0,)], "v double"), F.col("v")).collect()
    assert [(r["bin"], r["count"]) for r in same] == [(0, 2)]


def test_curves_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.1), (1, 0.1)]
    points = curves.score_points(frame(spark, rows, "label int, score double"))
    # pairs: positives above negatives, ties count half
    wins = sum((1.0 if p > n else 0.5 if p == n else 0.0) for y, p in rows if y for z, n in rows if not z)
    assert curves.roc_auc(points).first()["roc_auc"] == pytest.approx(wins / 9)
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in curves.pr_points(points).collect()}
    assert got[0.9] == (0.5, pytest.approx(1 / 3)) and got[0.1] == (0.5, 1.0)


def test_perfect_scores(spark):
    points = curves.score_points(frame(spark, [(1, 0.9), (0, 0.1)], "label int, score double"))
    assert curves.roc_auc(points).first()[0] == 1.0 and curves.pr_auc(points).first()[0] == 1.0


def test_threshold_tie_takes_the_lowest(spark):
    df = frame(spark, [("m", 1, 0.9), ("m", 0, 0.02)], "model string, label int, score double")
    row = evaluation.best_threshold(evaluation.threshold_table(df)).first()
    assert (row["threshold"], row["f1_score"]) == (0.05, 1.0)


def test_ranking_and_comparison(spark):
    df = frame(
        spark,
        [("first", 0.5, "OK"), ("best", 0.9, "OK"), ("broken", None, "failed"), ("also", 0.9, "OK")],
        "model string, f1_score double, status string",
    )
    ranks = {r["model"]: r["rank"] for r in evaluation.rank_models(df, "f1_score").collect()}
    assert ranks == {"also": 1, "best": 2, "first": 3}
    row = evaluation.comparison(df, "f1_score").first()
    assert row["best_model"] in ("best", "also") and row["worst_model"] == "first"
    assert (row["models_evaluated"], row["models_failed"]) == (3, 1)


def test_validation_needs_targets(spark):
    with pytest.raises(ValueError):
        evaluation.validate_test_table(frame(spark, [(1,)], "churned int"))


# ---- insights ------------------------------------------------------------------

def test_tier_bounds_and_empty_tier(spark):
    df = frame(spark, [(10.0, 0.4), (20.0, 0.7)], "total_sales double, churn_probability double")
    got = {r["tier"]: r for r in insights.revenue_at_risk(df).collect()}
    assert got["low_risk"]["customers"] == 1 and got["medium_risk"]["customers"] == 1
    assert tuple(got["high_risk"])[1:] == (0, 0.0, 0.0, 0.0)
    assert got["total"]["revenue_at_risk"] == pytest.approx(10 * 0.4 + 20 * 0.7)


def test_roi_without_budget_or_saving(spark):
    df = frame(spark, [(10.0, 0.2)], "total_sales double, churn_probability double")
    campaigns = frame(spark, [(0.0, "all"), (100.0, "high_risk")], "campaign_budget double, target_segment string")
    got = {r["target_segment"]: r for r in insights.campaign_roi(df, campaigns).collect()}
    assert got["all"]["roi_percentage"] == 0.0 and got["all"]["recommendation"] == "Not recommended"
    assert got["high_risk"]["payback_period_months"] is None and got["high_risk"]["roi_percentage"] == -100.0


def test_segments_at_the_bounds(spark):
    rows = [(1.0, 0.3), (2.0, 0.5), (3.0, 0.71), (100.0, 0.3), (100.0, 0.7), (100.0, 0.8)]
    df = materialize(frame(spark, rows, "total_sales double, churn_probability double"), "test")
    got = {r["segment"]: r["count"] for r in insights.customer_segments(df).collect()}
    assert got == {"Champions": 1, "Loyal Customers": 1, "At Risk": 1, "New Customers": 1, "Need Attention": 1, "Unassigned": 1}
    assert len(insights.customer_segments(df, show_unassigned=False).collect()) == 5


def test_rule_score_without_days(spark):
    df = frame(spark, [(1.0,), (9.0,)], "total_sales double")
    assert [r["churn_probability"] for r in insights.rule_scored(df).collect()] == [0.5, 0.2]


CLV = "membership_years int, days_since_last_purchase int, total_transactions int, avg_purchase_value double, churn_probability double, total_sales double, transaction_date timestamp_ntz"


def test_clv_guards_and_single_period(spark):
    from datetime import datetime

    df = frame(spark, [(0, 0, 4, 10.0, 0.5, 40.0, datetime(2020, 1, 5))], CLV)
    est = materialize(insights.clv_estimate(df), "test")
    row = est.first()
    assert row["estimated_annual_frequency"] == 4.0 and row["recency_factor"] is None
    trend = insights.clv_trends(est, "anything").collect()
    assert [(r["period"], r["clv_growth_rate"]) for r in trend] == [("2020-01", None)]


def test_growth_from_a_zero_period(spark):
    df = frame(spark, [("a", 0.0), ("b", 5.0), ("c", 10.0)], "period string, x double")
    got = [r["g"] for r in df.select("period", insights.growth("x", "period").alias("g")).orderBy("period").collect()]
    assert got == [None, 0.0, 1.0]


# ---- quality -------------------------------------------------------------------

def test_schema_findings(spark):
    df = frame(spark, [(1.0, "x")], "total_sales double, other string")
    got = {(r["column"], r["issue"]): r["severity"] for r in quality.schema_findings(df, quality.EXPECTED_SCHEMAS["training_data"]).collect()}
    assert got == {("churned", "missing"): "error", ("other", "extra"): "warning"}
    wrong = frame(spark, [(1, True)], "total_sales int, churned boolean")
    got = [(r["column"], r["issue"]) for r in quality.schema_findings(wrong, quality.EXPECTED_SCHEMAS["training_data"]).collect()]
    assert got == [("total_sales", "type")]
    assert quality.schema_findings(df, None).count() == 2


def test_drift_bounds(spark):
    schema = "column string, mean double, std double"
    base = frame(spark, [("a", 10.0, 0.0), ("b", 10.0, 1.0), ("gone", 1.0, 1.0)], schema)
    now = frame(spark, [("a", 12.0, 5.0), ("b", 12.1, 1.0), ("new", 1.0, 1.0)], schema)
    got = {(r["column"], r["metric"]): r["drifted"] for r in quality.drift(now, base).collect()}
    assert got == {("a", "mean"): False, ("b", "mean"): True, ("b", "std"): False}


def test_required_columns_and_gate(spark):
    df = frame(spark, [(-1.0, 200)], "total_sales double, age int")
    with pytest.raises(ValueError):
        quality.require_columns(df)
    report = quality.run_checks(df)
    row = report.first()
    assert (row["passed"], row["errors"]) == (False, 2)
    with pytest.raises(ValueError):
        quality.gate(report)
    quality.gate(quality.run_checks(frame(spark, [(1.0, 20)], "total_sales double, age int")))


def test_check_that_cannot_run_fails_the_report(spark):
    text = frame(spark, [("oops",)], "total_sales string")
    row = quality.run_checks(text).first()
    assert row["passed"] is False and row["problem"]
