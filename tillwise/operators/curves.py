"""ROC and precision-recall curves with exact areas.

Tied scores are aggregated first (map-side combine), the distinct scores are
stored, and the cumulative counts come from range-wise running totals, so no
single task ever sorts all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .cumulative import running_totals
from .quantiles import with_group_stats


def score_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest down: own and cumulated positives / negatives, and class totals."""
    by = list(by)
    counts = materialize(
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")),
        "scores",
    )
    points = running_totals(counts, "threshold", ["pos", "neg"], by=by)
    keyed = points.withColumn("_g", F.struct(*by) if by else F.lit(0))
    if by:
        totals = counts.groupBy(F.struct(*by).alias("_g")).agg(
            F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")
        )
        return keyed.join(materialize(totals, "class-totals"), "_g").drop("_g")
    return with_group_stats(
        keyed, F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), grouped=False
    ).drop("_g")


def roc_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate when everything at or above a score is called positive."""
    return points.select(
        *by, "threshold",
        F.coalesce(F.try_divide("cum_neg", "all_neg"), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide("cum_pos", "all_pos"), F.lit(0.0)).alias("tpr"),
    )


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area; each score step needs only its own and its cumulated counts."""
    step = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return points.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(step), F.max(F.col("all_pos") * F.col("all_neg"))), F.lit(0.0)).alias("roc_auc")
    )


def pr_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.select(
        *by, "threshold",
        F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.coalesce(F.try_divide("cum_pos", "all_pos"), F.lit(0.0)).alias("recall"),
    )


def pr_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area over recall, starting from precision 1 at recall 0."""
    here = F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    before_pos, before_all = F.col("cum_pos") - F.col("pos"), F.col("cum_pos") + F.col("cum_neg") - F.col("pos") - F.col("neg")
    before = F.coalesce(F.try_divide(before_pos, before_all), F.lit(1.0))
    step = F.try_divide("pos", "all_pos") * (here + before) / 2
    return points.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("pr_auc"))
