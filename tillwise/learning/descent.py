"""Linear models trained by a fixed number of full-batch gradient steps, in closed form.

On standardised columns one step is w <- w - 2 lr (R w - r), with R the feature
correlations and r the correlations with the target. Both come from one
distributed pass; the steps then touch d x d numbers only, whatever the number
of rows. For one feature the recursion sums up to w = r (1 - (1 - 2 lr)^T).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clean, total
from ..operators.correlation import correlation_matrix, cross_correlations
from ..operators.scaling import fit_means, impute

SIMPLE = {"epochs": 150, "lr": 0.001}
MULTIPLE = {"epochs": 150, "lr": 0.0001}


@dataclass
class LinearModel:
    """Weights on the original scale; scoring is one column expression."""

    features: list[str]
    weights: list[float]
    bias: float
    means: dict[str, float]
    history: list[float] = field(default_factory=list)
    #: Training state: weights on the standardised scale and the number of steps taken.
    state: list[float] = field(default_factory=list)
    steps: int = 0

    def expression(self) -> Column:
        filled = [F.coalesce(clean(f), F.lit(self.means[f])) for f in self.features]
        return total([F.lit(w) * x for w, x in zip(self.weights, filled)]) + F.lit(self.bias)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.expression())

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.features, self.weights, [self.means[f] for f in self.features])),
            "feature string, weight double, mean double",
        )


def simple_descent(
    df: DataFrame, features: Sequence[str], target: str, epochs: int = SIMPLE["epochs"], lr: float = SIMPLE["lr"]
) -> DataFrame:
    """One row: the feature most correlated with the target, and slope and intercept after ``epochs`` steps."""
    features = list(features)
    pairs = cross_correlations(df, list(features), [target]).withColumnRenamed("i", "pair")
    names = F.array(*[F.lit(f) for f in features])
    best = pairs.agg(
        F.max_by(F.struct("pair", "correlation"), F.struct(F.abs("correlation"), -F.col("pair"))).alias("b")
    ).select(F.col("b.pair").alias("pair"), F.coalesce("b.correlation", F.lit(0.0)).alias("r"))
    y = clean(target)
    known = df.where(y.isNotNull())
    moments = F.array(
        *[F.struct(F.avg(clean(f)).alias("m"), F.stddev_pop(clean(f)).alias("s")) for f in features]
    )
    stats = known.agg(moments.alias("x"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"))
    share = 1.0 - (1.0 - 2.0 * lr) ** epochs
    one = stats.withColumn("best", best.select(F.struct("*")).scalar())
    chosen = F.col("x")[F.col("best.pair")]
    slope = F.col("best.r") * share * F.coalesce(F.try_divide(F.col("sy"), chosen["s"]), F.lit(0.0))
    return one.select(
        names[F.col("best.pair")].alias("feature"),
        F.col("best.r").alias("correlation"),
        slope.alias("weight"),
        (F.col("my") - slope * chosen["m"]).alias("bias"),
    )


def fit_simple(df: DataFrame, features: Sequence[str], target: str, epochs: int = SIMPLE["epochs"], lr: float = SIMPLE["lr"]) -> LinearModel:
    row = simple_descent(df, features, target, epochs, lr).first()
    r, q = row["correlation"], 1.0 - 2.0 * lr
    history = [1.0 - r * r + r * r * q ** (2 * t) for t in range(epochs)]
    means = fit_means(df, [row["feature"]])
    return LinearModel([row["feature"]], [row["weight"]], row["bias"], means, history)


def fit_multiple(
    df: DataFrame, features: Sequence[str], target: str, epochs: int = MULTIPLE["epochs"], lr: float = MULTIPLE["lr"],
    start: LinearModel | None = None,
) -> LinearModel:
    """All features; constant columns keep weight 0. ``start`` goes on from a model's state, with its means."""
    features = list(features)
    if start is not None and (start.features != features or len(start.state) != len(features)):
        raise ValueError("the model to go on from was trained on other features")
    means = start.means if start else fit_means(df, features)
    filled = impute(df.where(clean(target).isNotNull()), means)
    row = filled.agg(
        *[F.stddev_pop(f).alias(f) for f in features],
        F.avg(clean(target)).alias("_my"), F.stddev_pop(clean(target)).alias("_sy"),
    ).first()
    matrix = np.nan_to_num(correlation_matrix(filled, [*features, target]))
    big_r, r = matrix[:-1, :-1], matrix[:-1, -1]
    w, history = (np.array(start.state), list(start.history)) if start else (np.zeros(len(features)), [])
    for _ in range(epochs):
        history.append(float(1.0 - 2.0 * w @ r + w @ big_r @ w))
        w = w - 2.0 * lr * (big_r @ w - r)
    spread = np.array([row[f] or 1.0 for f in features])
    weights = row["_sy"] * w / spread
    bias = float(row["_my"] - sum(wt * means[f] for wt, f in zip(weights, features)))
    steps = epochs + (start.steps if start else 0)
    return LinearModel(features, [float(x) for x in weights], bias, means, history, [float(x) for x in w], steps)
