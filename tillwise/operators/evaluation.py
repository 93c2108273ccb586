"""Model quality from long prediction tables ``(model, label, prediction | score)``.

All models are evaluated by one grouped aggregation with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import as_col, pearson, ratio_or_zero
from .quantiles import exact_quantiles, with_group_stats

# The 19 cut-offs tried when a threshold is tuned.
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
HISTOGRAM_BINS = 30


def to_class(p: str | Column, threshold: float = 0.5) -> Column:
    """1 where a probability is above one half."""
    return (as_col(p) > threshold).cast("int")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("model",)) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def f1_of(precision: str | Column, recall: str | Column) -> Column:
    precision, recall = as_col(precision), as_col(recall)
    return ratio_or_zero(2 * precision * recall, precision + recall)


def class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("accuracy", ratio_or_zero(tp + tn, tn + fp + fn + tp))
        .withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
        .withColumn("f1_score", f1_of("precision", "recall"))
        .withColumn("specificity", ratio_or_zero(tn, tn + fp))
    )


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("model",)
) -> DataFrame:
    """RMSE, MAE, R2 (0 for a constant target), MAPE over positive targets and over non-zero ones."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(spread == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.sum(e * e), spread)).alias("r2"),
        F.coalesce(F.avg(F.when(y > 0, F.abs(e / y))) * 100, F.lit(0.0)).alias("mape"),
        F.coalesce(F.avg(F.when(y != 0, F.abs(e / y))) * 100, F.lit(0.0)).alias("mape_unmasked"),
    )


def histogram(df: DataFrame, value: Column, by: Sequence[str] = (), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed, equal values give one bin."""
    rows = df.select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), *by, value.cast("double").alias("_v"))
    rows = with_group_stats(rows, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), grouped=bool(by))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))
    )
    return (
        rows.where("_v is not null")
        .select(*by, slot.cast("int").alias("bin"), "_lo", width.alias("_w"))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("count"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
        .select(
            *by, "bin",
            (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"),
            (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"),
            "count",
        )
    )


def error_percentiles(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("model",)
) -> DataFrame:
    """50/75/90/95 percentiles and the mean of absolute errors. Hand in a stored table."""
    error = F.abs(F.col(label).cast("double") - F.col(prediction).cast("double"))
    names = {0.5: "p50", 0.75: "p75", 0.9: "p90", 0.95: "p95"}
    points = exact_quantiles(df, error, list(names), by=list(by))
    wide = points.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )
    return wide.join(df.groupBy(*by).agg(F.avg(error).alias("mean_error")), list(by))


def residual_stats(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("model",)) -> DataFrame:
    residual = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        F.avg(residual).alias("mean_residual"), F.stddev_pop(residual).alias("std_residual")
    )


def predicted_actual(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("model",)) -> DataFrame:
    """Correlation of prediction and target, and common axis bounds."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        pearson(y, p).alias("correlation"),
        F.least(F.min(y), F.min(p)).alias("axis_min"),
        F.greatest(F.max(y), F.max(p)).alias("axis_max"),
    )


def threshold_table(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",),
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """F1 at each threshold.

    Each row is counted once, under the number of thresholds it reaches, instead
    of once per threshold. The counts (at most 20 per model and class) are then
    cumulated from the highest threshold down.
    """
    ordered = sorted(thresholds)
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ordered), F.lit(0))
    y = F.col(label)
    counts = (
        df.groupBy(*by, reached.alias("_k"))
        .agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    )
    grid = F.explode(
        F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(ordered)])
    )
    # every count row reaches thresholds 1.._k: a fixed fan-out of count rows
    return (
        counts.select(*by, "_k", "_p", "_n", grid.alias("_t"))
        .groupBy(*by, F.col("_t.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(F.col("_k") >= F.col("_t._i"), F.col("_p")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("_k") >= F.col("_t._i"), F.col("_n")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("_k") < F.col("_t._i"), F.col("_p")).otherwise(0)).alias("fn"),
        )
        .withColumn("precision", ratio_or_zero("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio_or_zero("tp", F.col("tp") + F.col("fn")))
        .withColumn("f1_score", f1_of("precision", "recall"))
        .select(*by, "threshold", "precision", "recall", "f1_score")
    )


def best_threshold(table: DataFrame, by: Sequence[str] = ("model",), threshold: str = "threshold") -> DataFrame:
    """Threshold with the highest F1; the lowest threshold wins a tie."""
    return table.groupBy(*by).agg(
        F.max_by(threshold, F.struct("f1_score", -F.col(threshold))).alias("threshold"),
        F.max("f1_score").alias("f1_score"),
    )


def base_rate_threshold(df: DataFrame, label: str, score: str) -> float:
    """Score cut that labels about as many rows positive as there are positives."""
    base = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    prob = min(0.95, max(0.05, 1.0 - base))
    return exact_quantiles(df, score, [prob]).first()["quantile"]


def rank_models(results: DataFrame, metric: str) -> DataFrame:
    """Usable results with their 1-based rank by a metric, ties by name (one row per model)."""
    order = Window.orderBy(F.col(metric).desc(), "model")
    return results.where(F.col("status") == "OK").withColumn("rank", F.row_number().over(order))


def comparison(results: DataFrame, metric: str) -> DataFrame:
    """Best and worst model by a metric, and how many were evaluated or failed."""
    ok = F.col("status") == "OK"
    key = F.when(ok, F.col(metric))
    return results.agg(
        F.max_by("model", key).alias("best_model"),
        F.max(key).alias("best_value"),
        F.min_by("model", key).alias("worst_model"),
        F.min(key).alias("worst_value"),
        F.count_if(ok).alias("models_evaluated"),
        F.count_if(~ok).alias("models_failed"),
    )


def model_table(results: DataFrame, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Chosen models with metrics to three decimals and their origin."""
    tag = F.lower("model")
    origin = F.when(tag.contains("(scratch)"), "scratch").when(tag.contains("(sklearn)"), "library")
    return results.where(F.col("model").isin(list(models))).select(
        "model", origin.alias("kind"), *[F.round(m, 3).alias(m) for m in metrics]
    )


def validate_test_table(df: DataFrame, regression_target: str = "total_sales", class_target: str = "churned") -> DataFrame:
    """Targets present, their distribution in one row; a missing target raises."""
    absent = [c for c in (regression_target, class_target) if c not in df.columns]
    if absent:
        raise ValueError(f"missing target columns: {absent}")
    y = F.col(regression_target).cast("double")
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(y).alias("sales_mean"),
        F.stddev_pop(y).alias("sales_std"),
        F.avg(F.col(class_target).cast("double")).alias("churn_rate"),
        F.count_if(F.col(class_target) == 1).alias("churned"),
        F.count_if(F.col(class_target) == 0).alias("retained"),
    )
