"""Feature importance, split usage, attributions and loss history as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import clean
from ..functions.scalars import one_row
from .boosting import StumpModel
from .clusters import MarginModel
from .descent import LinearModel
from .gradient import LineModel
from .registry import TunedClassifier
from .trees import TreeModel


def last_stage(model):
    if isinstance(model, TunedClassifier):
        model = model.model
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance, rank)``: tree importances or absolute weights, highest first."""
    stage = last_stage(model)
    if hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    elif isinstance(stage, LinearModel):
        values = [abs(stage.weights[stage.features.index(f)]) if f in stage.features else 0.0 for f in features]
    elif isinstance(stage, TreeModel):
        values = stage.importances()
    elif isinstance(stage, LineModel):
        values = [abs(w) for w in stage.weights]
    elif isinstance(stage, StumpModel):
        values = [sum(abs(s.alpha) for s in stage.stumps if s.feature == f) for f in features]
    elif isinstance(stage, MarginModel):
        values = [abs(w) for w in stage.direction]
    elif hasattr(stage, "coefficients"):
        values = [abs(c) for c in stage.coefficients.toArray()]
    else:
        raise ValueError(f"{type(stage).__name__} has no importances")
    if len(values) != len(features):
        raise ValueError("the model was trained on transformed features")
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
    order = Window.orderBy(F.col("importance").desc(), "feature")  # one row per feature
    return rows.withColumn("rank", F.row_number().over(order))


def top_weights(spark: SparkSession, model, features: Sequence[str], n: int = 3) -> DataFrame:
    return importance(spark, model, features).where(F.col("rank") <= n)


def split_usage(spark: SparkSession, saved_stage: str, features: Sequence[str]) -> DataFrame:
    """How often the trees of a saved model split on each feature."""
    nodes = spark.read.parquet(f"{saved_stage}/data")
    split = "nodeData.split.featureIndex" if "nodeData" in nodes.columns else "split.featureIndex"
    names = F.array(*[F.lit(f) for f in features])
    used = nodes.select(F.col(split).alias("i")).where(F.col("i") >= 0)
    return used.groupBy(names[F.col("i")].alias("feature")).agg(F.count("*").alias("splits"))


def tree_usage(spark: SparkSession, model: TreeModel) -> DataFrame:
    """``(feature, splits)`` of the features that a model's trees split on."""
    return spark.createDataFrame([*model.usage().items()], "feature string, splits long")


def linear_attributions(df: DataFrame, weights: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Contribution w (x - mean) of every feature to every row, with its sign."""
    means = one_row(df.agg(*[F.avg(clean(f)).alias(f) for f in weights]))
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), clean(f).alias("value"),
                (F.lit(float(w)) * (F.coalesce(clean(f), F.col("_means")[f]) - F.col("_means")[f])).alias("contribution"),
            )
            for f, w in weights.items()
        ]
    )
    rows = df.withColumn("_means", means).select(*keys, F.inline(parts))
    return rows.withColumn("impact", F.when(F.col("contribution") > 0, "positive").otherwise("negative"))


def loss_history(spark: SparkSession, model) -> DataFrame:
    """``(epoch, loss)`` of a trained model."""
    stage = last_stage(model)
    losses = stage.history if isinstance(stage, (LinearModel, LineModel)) else stage.summary.objectiveHistory
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "epoch int, loss double")
