"""Saved models: Spark ML pipelines in their own format, formula models as one-row tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..learning.boosting import Stump, StumpModel
from ..learning.clusters import MarginModel
from ..learning.descent import LinearModel
from ..learning.gradient import LineModel
from ..learning.minibatch import PolynomialModel
from ..learning.registry import TunedClassifier
from ..learning.regression_boosting import BoostModel
from ..learning.trees import NODE_SCHEMA, TreeModel

SUFFIXES = ["_latest.pkl", ".pkl"]


def save(spark: SparkSession, model, path: str, features: Sequence[str]) -> None:
    """Overwrite the model at ``path``; its feature list goes with it."""
    pipeline, facts = None, {}
    if isinstance(model, LinearModel):
        facts = {
            "features": model.features, "weights": model.weights, "bias": model.bias, "means": model.means,
            "history": model.history, "state": model.state, "steps": model.steps,
        }
    elif isinstance(model, (LineModel, PolynomialModel)):
        facts = asdict(model)
    elif isinstance(model, BoostModel):
        facts = {**asdict(model), "trees": [[[node, *entry] for node, entry in tree.items()] for tree in model.trees]}
    elif isinstance(model, TreeModel):
        facts = {"features": model.features, "means": model.means, "trees": model.trees, "votes": model.votes}
        spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    elif isinstance(model, StumpModel):
        facts = {
            "means": model.means, "threshold": model.threshold,
            "stumps": [[s.feature, s.threshold, s.polarity, s.alpha] for s in model.stumps],
        }
    elif isinstance(model, MarginModel):
        pipeline = model.prep
        facts = {"direction": model.direction, "offset": model.offset, "threshold": model.threshold}
    elif isinstance(model, TunedClassifier):
        pipeline, facts = model.model, {"threshold": model.threshold}
    else:
        pipeline = model
    if pipeline is not None:
        pipeline.write().overwrite().save(f"{path}/pipeline")
    row = [(type(model).__name__, list(features), json.dumps(facts))]
    table = spark.createDataFrame(row, "kind string, feature_cols array<string>, facts string")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/model")


def load(spark: SparkSession, path: str):
    """(model, feature list) saved by :func:`save`."""
    row = spark.read.schema("kind string, feature_cols array<string>, facts string").json(f"{path}/model").first()
    facts = json.loads(row["facts"])
    kind = row["kind"]
    if kind == "LinearModel":
        model = LinearModel(**facts)
    elif kind == "LineModel":
        model = LineModel(**facts)
    elif kind == "PolynomialModel":
        model = PolynomialModel(**facts)
    elif kind == "BoostModel":
        model = BoostModel(**{**facts, "trees": [{n: (f, cut, value) for n, f, cut, value in tree} for tree in facts["trees"]]})
    elif kind == "TreeModel":
        nodes = [tuple(r) for r in spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").collect()]  # the model itself
        model = TreeModel(nodes=nodes, **facts)
    elif kind == "StumpModel":
        model = StumpModel(facts["means"], [Stump(*s) for s in facts["stumps"]], facts["threshold"])
    else:
        pipeline = PipelineModel.load(f"{path}/pipeline")
        if kind == "MarginModel":
            model = MarginModel(pipeline, **facts)
        elif kind == "TunedClassifier":
            model = TunedClassifier(pipeline, facts["threshold"])
        else:
            model = pipeline
    return model, list(row["feature_cols"])


def candidates(name: str) -> list[str]:
    return [f"{name}_latest.pkl", f"{name}.pkl", name]


def load_named(spark: SparkSession, folder: str, name: str):
    """The first of the candidate folders that holds a model."""
    for candidate in candidates(name):
        try:
            return load(spark, f"{folder}/{candidate}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no model named {name} in {folder}")


def load_or_fit(spark: SparkSession, path: str, features: Sequence[str], fit: Callable[[], object]):
    """Reuse a saved model, else train and save it."""
    try:
        return load(spark, path)[0]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    model = fit()
    save(spark, model, path, features)
    return model


def resume(spark: SparkSession, path: str, features: Sequence[str], fit: Callable[..., object]):
    """Go on training a saved model, or start one: ``fit(start=model or None)``. The result is saved.

    A model of other features is not gone on from; training starts anew.
    """
    start = None
    try:
        start, known = load(spark, path)
        if known != list(features):
            start = None
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    model = fit(start=start)
    save(spark, model, path, features)
    return model


def catalogue(names: DataFrame, column: str = "name") -> DataFrame:
    """``(model, task)``: suffix stripped, task read from the name, both where it is unclear."""
    base = F.regexp_replace(F.col(column), r"(_latest)?\.pkl$", "")
    low = F.lower("model")
    both = F.array(F.lit("classification"), F.lit("regression"))
    tasks = (
        F.when(low.contains("classification"), F.array(F.lit("classification")))
        .when(low.contains("regression"), F.array(F.lit("regression")))
        .when(low.contains("sklearn") & low.contains("random_forest"), F.array(F.lit("classification")))
        .when(low.contains("sklearn") & low.contains("xgboost"), F.array(F.lit("regression")))
        .otherwise(both)
    )
    return names.select(base.alias("model")).select("model", F.explode(tasks).alias("task")).orderBy("task", "model")
