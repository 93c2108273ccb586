"""Churn classifiers from two clusters: the margin between the centres is the score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import flag, total
from ..operators.evaluation import base_rate_threshold, best_threshold, threshold_table
from ..operators.quantiles import exact_quantiles
from ..session import materialize
from .prep import vector_items, vector_stages


@dataclass
class MarginModel:
    """Squared distance to the retain centre minus that to the churn centre, cut at a threshold.

    The quadratic terms cancel, so the score is linear in the scaled features.
    """

    prep: PipelineModel
    direction: list[float]
    offset: float
    threshold: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        items = vector_items("features", len(self.direction))
        margin = total([F.lit(w) * x for w, x in zip(self.direction, items)]) + F.lit(self.offset)
        scored = self.prep.transform(df).withColumn("score", margin)
        return scored.withColumn("prediction", flag(F.col("score") >= self.threshold).cast("double"))


def _margin(prep: PipelineModel, centres, clustered: DataFrame) -> MarginModel:
    """Two rows say which cluster churns more; its centre is the positive one."""
    if len(centres) != 2:
        raise ValueError("the rows do not divide into two clusters")
    rates = {r["prediction"]: r["rate"] for r in clustered.groupBy("prediction").agg(F.avg("label").alias("rate")).collect()}
    positive = max((0, 1), key=lambda k: (rates.get(k, 0.0), -k))
    p, n = centres[positive], centres[1 - positive]
    return MarginModel(prep, [float(2 * (a - b)) for a, b in zip(p, n)], float(n @ n - p @ p))


def _scaled(df: DataFrame, features: Sequence[str], center: bool = True) -> tuple[PipelineModel, DataFrame]:
    prep = Pipeline(stages=vector_stages(features, center=center)).fit(df)
    return prep, materialize(prep.transform(df).select("features", "label"), "scaled")


def fit_kmeans(df: DataFrame, features: Sequence[str], starts: int = 5, max_iter: int = 100, seed: int = 42) -> MarginModel:
    """Best of several k-means starts; the threshold labels about the base rate positive."""
    prep, scaled = _scaled(df, features)
    fits = [KMeans(k=2, maxIter=max_iter, seed=seed + i).fit(scaled) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    model = _margin(prep, best.clusterCenters(), best.transform(scaled))
    scored = materialize(model.transform(df).select("label", "score"), "margins")
    model.threshold = base_rate_threshold(scored, "label", "score")
    return model


def fit_hierarchical(df: DataFrame, features: Sequence[str], seed: int = 42) -> MarginModel:
    """Bisecting k-means on all rows; of 19 score quantiles the one with the best F1 is the threshold."""
    # the first split starts from the mean plus a nudge in proportion to its length,
    # which is nothing for centred data; the margin does not depend on centring
    prep, scaled = _scaled(df, features, center=False)
    fit = BisectingKMeans(k=2, seed=seed).fit(scaled)
    model = _margin(prep, fit.clusterCenters(), fit.transform(scaled))
    scored = materialize(model.transform(df).select(F.lit("m").alias("model"), "label", "score"), "margins")
    probs = [round(0.05 * i, 2) for i in range(1, 20)]
    cuts = sorted({r["quantile"] for r in exact_quantiles(scored, "score", probs).collect()})
    model.threshold = best_threshold(threshold_table(scored, thresholds=cuts)).first()["threshold"]
    return model
