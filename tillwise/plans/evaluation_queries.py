"""Catalogue: model evaluation on prediction tables derived from the customers.

The predictions come from column formulas, so every metric can be recomputed in
SQL; trained models go through the same operators in ``model_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import sigmoid
from ..operators import curves, evaluation
from ..session import materialize
from ..sources import reports
from .oracle_base import SCORED, with_
from .shared import TIE_SHIFT, rounded, scored_customers
from . import tables

BY = ["model"]


def _stack(df: DataFrame, keep: list[str], rows: dict[str, object], out: str) -> DataFrame:
    """Long form: one row per model, by a fixed fan-out of every input row."""
    options = F.array(*[F.struct(F.lit(m).alias("model"), v.alias(out)) for m, v in rows.items()])
    return df.select(*keep, F.inline(options))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """(customer_id, label, model, score) for three formula classifiers."""
    scored = scored_customers(spark, d, "churned", "num_purchases").withColumnRenamed("churned", "label")
    days = F.coalesce("days_since_last_purchase", F.lit(365))
    activity = sigmoid((days - 200) / 100.0 - (F.col("num_purchases") - 40) / 20.0)
    return _stack(
        scored,
        ["customer_id", "label"],
        {
            "Rule (scratch)": F.col("churn_probability"),
            "Activity (scratch)": F.round(F.lit(TIE_SHIFT) + activity, 6),
            "Never (sklearn)": F.lit(0.0),
        },
        "score",
    )


def class_predictions(spark: SparkSession, d: str) -> DataFrame:
    return class_scores(spark, d).withColumn("prediction", evaluation.to_class("score"))


def sales_predictions(spark: SparkSession, d: str) -> DataFrame:
    """(customer_id, label, model, prediction) for three formula regressors."""
    base = tables.customers(spark, d).withColumnRenamed("total_sales", "label")
    return _stack(
        base,
        ["customer_id", "label"],
        {
            "List price (scratch)": F.col("gross_sales") * 0.95,
            "Volume (sklearn)": F.col("quantity") * 1400.0,
            "Constant (scratch)": F.lit(500000.0),
        },
        "prediction",
    )


def _class_metrics(spark, d):
    return evaluation.class_metrics(evaluation.confusion(class_predictions(spark, d)))


def _results(spark, d):
    """Metric rows with a status; a model without positive predictions counts as failed."""
    status = F.when(F.col("tp") + F.col("fp") > 0, "OK").otherwise("no positive predictions")
    return _class_metrics(spark, d).withColumn("status", status)


def _points(spark, d, by=BY):
    return curves.score_points(class_scores(spark, d), by=by)


def _single_points(spark, d):
    one = class_scores(spark, d).where(F.col("model") == "Activity (scratch)").drop("model")
    return curves.score_points(one)


def _stored_sales(spark, d):
    return materialize(sales_predictions(spark, d), "predictions")


def _base_rate(spark, d):
    one = materialize(class_scores(spark, d).where(F.col("model") == "Activity (scratch)"), "scores")
    cut = evaluation.base_rate_threshold(one, "label", "score")
    return one.agg(
        F.lit(cut).alias("threshold"), F.count_if(F.col("score") >= cut).alias("predicted_positive"),
        F.count_if(F.col("label") == 1).alias("positive"),
    )


def _model_ranking(spark, d):
    other = sales_predictions(spark, d)
    quality = evaluation.regression_metrics(other).select(
        "model", F.lit("regression").alias("task"), F.col("r2").alias("metric"), F.lit("OK").alias("status")
    )
    results = _results(spark, d).select("model", F.lit("classification").alias("task"), F.col("f1_score").alias("metric"), "status")
    return evaluation.rank_models(results.unionByName(quality), "metric")


def _scatter(spark, d):
    from ..operators.sampling import sample_n

    return sample_n(sales_predictions(spark, d).where(F.col("model") == "Volume (sklearn)"), "customer_id", 100)


QUERIES = {
    "confusion": lambda spark, d: evaluation.confusion(class_predictions(spark, d)),
    "class_metrics": lambda spark, d: rounded(_class_metrics(spark, d), 6),
    "reg_metrics": lambda spark, d: rounded(evaluation.regression_metrics(sales_predictions(spark, d)), 4),
    "roc_points": lambda spark, d: rounded(curves.roc_points(_points(spark, d), BY), 6),
    "roc_auc": lambda spark, d: rounded(curves.roc_auc(_points(spark, d), BY), 6),
    "pr_points": lambda spark, d: rounded(curves.pr_points(_points(spark, d), BY), 6),
    "pr_auc": lambda spark, d: rounded(curves.pr_auc(_points(spark, d), BY), 6),
    "cumulative_gains": lambda spark, d: rounded(
        _single_points(spark, d).select("threshold", "cum_pos", "cum_neg", "all_pos", "all_neg"), 6
    ),
    "residual_hist": lambda spark, d: rounded(
        evaluation.histogram(_stored_sales(spark, d), F.col("label") - F.col("prediction"), by=BY), 2
    ),
    "error_percentiles": lambda spark, d: rounded(evaluation.error_percentiles(_stored_sales(spark, d)), 4),
    "residual_stats": lambda spark, d: rounded(evaluation.residual_stats(sales_predictions(spark, d)), 4),
    "pred_actual": lambda spark, d: rounded(evaluation.predicted_actual(sales_predictions(spark, d)), 4),
    "scatter_sample": lambda spark, d: rounded(_scatter(spark, d)),
    "threshold_table": lambda spark, d: rounded(evaluation.threshold_table(class_scores(spark, d)), 6),
    "threshold_tuning": lambda spark, d: rounded(
        evaluation.best_threshold(evaluation.threshold_table(class_scores(spark, d))), 6
    ),
    "base_rate_threshold": lambda spark, d: rounded(_base_rate(spark, d), 6),
    "prob_to_class": lambda spark, d: class_predictions(spark, d).groupBy("model", "prediction").agg(
        F.count("*").alias("customers")
    ),
    "model_ranking": lambda spark, d: rounded(_model_ranking(spark, d), 6),
    "model_comparison": lambda spark, d: rounded(evaluation.comparison(_results(spark, d), "f1_score"), 6),
    "model_table": lambda spark, d: evaluation.model_table(
        rounded(_class_metrics(spark, d), 6), ["Rule (scratch)", "Never (sklearn)"], ["accuracy", "f1_score", "recall"]
    ),
    "metrics_long": lambda spark, d: rounded(
        reports.metric_rows(_class_metrics(spark, d), ["accuracy", "precision", "recall", "f1_score"]), 6
    ),
    "test_table_check": lambda spark, d: rounded(
        evaluation.validate_test_table(tables.customers(spark, d).select("total_sales", "churned")), 4
    ),
}

_SCORES = SCORED + """, sc AS (
  SELECT customer_id, churned AS label, 'Rule (scratch)' AS model, p AS score FROM scored
  UNION ALL
  SELECT customer_id, churned, 'Activity (scratch)',
         round(1 / (1 + exp(-greatest(-30.0::double, least(30.0::double,
           (coalesce(days_since_last_purchase, 365) - 200) / 100.0::double - (num_purchases - 40) / 20.0::double)))), 6)
  FROM scored
  UNION ALL SELECT customer_id, churned, 'Never (sklearn)', 0.0::double FROM scored
), pr AS (SELECT *, CASE WHEN score > 0.5::double THEN 1 ELSE 0 END AS prediction FROM sc), cm AS (
  SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM pr GROUP BY 1
), pm AS (
  SELECT *, (tp + tn) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM cm
), met AS (
  SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1_score FROM pm
)"""
_SALES = SCORED + """, sp AS (
  SELECT customer_id, total_sales AS label, 'List price (scratch)' AS model, gross_sales * 0.95::double AS prediction FROM scored
  UNION ALL SELECT customer_id, total_sales, 'Volume (sklearn)', quantity * 1400.0::double FROM scored
  UNION ALL SELECT customer_id, total_sales, 'Constant (scratch)', 500000.0::double FROM scored
), rm AS (
  SELECT model, sqrt(avg((label - prediction) ^ 2)) AS rmse, avg(abs(label - prediction)) AS mae,
         1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)) AS r2,
         avg(abs((label - prediction) / label)) FILTER (label > 0) * 100 AS mape,
         avg(abs((label - prediction) / label)) FILTER (label <> 0) * 100 AS mape_unmasked
  FROM sp GROUP BY 1
)"""
_CURVE = _SCORES + """, g AS (
  SELECT model, score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM sc GROUP BY 1, 2
), c AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
         sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg
  FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)
), r AS (
  SELECT *, cum_neg / all_neg AS fpr, cum_pos / all_pos AS tpr, cum_pos / (cum_pos + cum_neg) AS prec FROM c
), lg AS (
  SELECT *, coalesce(lag(fpr) OVER w, 0) AS pf, coalesce(lag(tpr) OVER w, 0) AS pt, coalesce(lag(prec) OVER w, 1) AS pp
  FROM r WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)
)"""
_THRESHOLDS = _SCORES + """, t AS (SELECT round(i * 0.05::double, 2) AS threshold FROM range(1, 20) x(i)), tt AS (
  SELECT model, threshold, sum((score >= threshold - 1e-6 AND label = 1)::integer) AS tp,
         sum((score >= threshold - 1e-6 AND label = 0)::integer) AS fp,
         sum((score < threshold - 1e-6 AND label = 1)::integer) AS fn
  FROM sc, t GROUP BY 1, 2
), tm AS (
  SELECT model, threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM tt
), tf AS (
  SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1_score FROM tm
)"""

ORACLES = {
    "confusion": with_(_SCORES, "SELECT * FROM cm"),
    "class_metrics": with_(
        _SCORES,
        'SELECT model, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", '
        "round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(specificity, 6) AS specificity FROM met",
    ),
    "reg_metrics": with_(
        _SALES,
        "SELECT model, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, round(mape, 4) AS mape, "
        "round(mape_unmasked, 4) AS mape_unmasked FROM rm",
    ),
    "roc_points": with_(
        _CURVE,
        "SELECT model, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r",
    ),
    "roc_auc": with_(_CURVE, "SELECT model, round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS roc_auc FROM lg GROUP BY 1"),
    "pr_points": with_(
        _CURVE,
        'SELECT model, round(threshold, 6) AS threshold, round(prec, 6) AS "precision", round(tpr, 6) AS recall FROM r',
    ),
    "pr_auc": with_(_CURVE, "SELECT model, round(sum((tpr - pt) * (prec + pp) / 2), 6) AS pr_auc FROM lg GROUP BY 1"),
    "cumulative_gains": with_(
        _CURVE,
        "SELECT round(threshold, 6) AS threshold, cum_pos::bigint AS cum_pos, cum_neg::bigint AS cum_neg, "
        "all_pos::bigint AS all_pos, all_neg::bigint AS all_neg FROM c WHERE model = 'Activity (scratch)'",
    ),
    "residual_hist": with_(
        _SALES,
        """, e AS (SELECT model, label - prediction AS v FROM sp),
b AS (SELECT model, min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM e GROUP BY 1),
h AS (SELECT e.model, CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / nullif(w, 0)), 29) END::integer AS bin, lo, w
      FROM e JOIN b ON e.model = b.model)
SELECT model, bin, round(any_value(lo) + bin * any_value(w), 2) AS lower,
       round(any_value(lo) + (bin + 1) * any_value(w), 2) AS upper, count(*) AS "count" FROM h GROUP BY 1, 2""",
    ),
    "error_percentiles": with_(
        _SALES,
        ", e AS (SELECT model, abs(label - prediction) AS v FROM sp) SELECT model, "
        + ", ".join(f"round(quantile_cont(v, {q}), 4) AS {n}" for q, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95")))
        + ", round(avg(v), 4) AS mean_error FROM e GROUP BY 1",
    ),
    "residual_stats": with_(
        _SALES,
        "SELECT model, round(avg(label - prediction), 4) AS mean_residual, "
        "round(stddev_pop(label - prediction), 4) AS std_residual FROM sp GROUP BY 1",
    ),
    "pred_actual": with_(
        _SALES,
        "SELECT model, round(CASE WHEN stddev_pop(prediction) > 0 THEN corr(label, prediction) END, 4) AS correlation, "
        "round(least(min(label), min(prediction)), 4) AS axis_min, "
        "round(greatest(max(label), max(prediction)), 4) AS axis_max FROM sp GROUP BY 1",
    ),
    "scatter_sample": with_(
        _SALES,
        "SELECT customer_id, round(label, 4) AS label, model, round(prediction, 4) AS prediction FROM sp "
        "WHERE model = 'Volume (sklearn)' "
        "ORDER BY ('0x' || substr(md5(customer_id::varchar || '|42'), 1, 15))::bigint, customer_id LIMIT 100",
    ),
    "threshold_table": with_(
        _THRESHOLDS,
        'SELECT model, threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, '
        "round(f1_score, 6) AS f1_score FROM tf",
    ),
    "threshold_tuning": with_(
        _THRESHOLDS,
        ", o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_score DESC, threshold) AS rn FROM tf) "
        "SELECT model, threshold, round(f1_score, 6) AS f1_score FROM o WHERE rn = 1",
    ),
    "base_rate_threshold": with_(
        _SCORES,
        """, a AS (SELECT score, label FROM sc WHERE model = 'Activity (scratch)'),
q AS (SELECT greatest(0.05::double, least(0.95::double, 1 - avg(label))) AS q FROM a),
s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM a),
cut AS (
  SELECT max(CASE WHEN i = floor(q * (n - 1)) THEN score END)
         + (max(CASE WHEN i = ceil(q * (n - 1)) THEN score END) - max(CASE WHEN i = floor(q * (n - 1)) THEN score END))
           * (max(q * (n - 1)) - floor(max(q * (n - 1)))) AS cut
  FROM s, q
)
SELECT round(any_value(cut), 6) AS threshold, count(*) FILTER (score >= cut) AS predicted_positive,
       count(*) FILTER (label = 1) AS positive FROM a, cut""",
    ),
    "prob_to_class": with_(_SCORES, "SELECT model, prediction, count(*) AS customers FROM pr GROUP BY 1, 2"),
    "model_ranking": with_(
        _SCORES + _SALES[len(SCORED):],
        """, al AS (
  SELECT model, 'classification' AS task, f1_score AS metric,
         CASE WHEN tp + fp > 0 THEN 'OK' ELSE 'no positive predictions' END AS status FROM met
  UNION ALL SELECT model, 'regression', r2, 'OK' FROM rm
)
SELECT model, task, round(metric, 6) AS metric, status,
       row_number() OVER (ORDER BY metric DESC, model)::integer AS rank FROM al WHERE status = 'OK'""",
    ),
    "model_comparison": with_(
        _SCORES,
        "SELECT arg_max(model, f1_score) FILTER (tp + fp > 0) AS best_model, "
        "round(max(f1_score) FILTER (tp + fp > 0), 6) AS best_value, "
        "arg_min(model, f1_score) FILTER (tp + fp > 0) AS worst_model, "
        "round(min(f1_score) FILTER (tp + fp > 0), 6) AS worst_value, "
        "count(*) FILTER (tp + fp > 0) AS models_evaluated, count(*) FILTER (tp + fp = 0) AS models_failed FROM met",
    ),
    "model_table": with_(
        _SCORES,
        "SELECT model, CASE WHEN model LIKE '%(scratch)' THEN 'scratch' ELSE 'library' END AS kind, "
        "round(accuracy, 3) AS accuracy, round(f1_score, 3) AS f1_score, round(recall, 3) AS recall "
        "FROM met WHERE model IN ('Rule (scratch)', 'Never (sklearn)')",
    ),
    "metrics_long": with_(
        _SCORES,
        " UNION ALL ".join(
            f"SELECT lower(replace(replace(replace(model, ' ', '_'), '(', ''), ')', '')) || '_{m}' AS name, model, "
            f"'{m}' AS metric, round(\"{m}\", 6) AS value FROM met"
            for m in ("accuracy", "precision", "recall", "f1_score")
        ),
    ),
    "test_table_check": with_(
        SCORED,
        'SELECT count(*) AS "rows", round(avg(total_sales), 4) AS sales_mean, round(stddev_pop(total_sales), 4) AS sales_std, '
        "round(avg(churned), 4) AS churn_rate, count(*) FILTER (churned = 1) AS churned, "
        "count(*) FILTER (churned = 0) AS retained FROM scored",
    ),
}
