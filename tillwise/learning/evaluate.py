"""Train all families, evaluate all models, compare them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluation
from ..session import materialize
from .registry import FAMILIES, Family
from .scoring import positive_score


def train_all(
    train: DataFrame, features: Sequence[str], key: str, chosen: Sequence[Family]
) -> tuple[dict[str, object], dict[str, str]]:
    """(models, failures by name). A family that fails is reported, the others go on."""
    stored = materialize(train, "train")
    models, failures = {}, {}
    for family in chosen:
        try:
            models[family.name] = family.fit(stored, features, key)
        except Exception as problem:  # one bad family must not stop the run
            failures[family.name] = f"{type(problem).__name__}: {problem}"
    return models, failures


def predictions(models: Mapping[str, object], test: DataFrame, key: str) -> DataFrame:
    """Long hold-out predictions ``(model, key, label, prediction, score)`` of all models."""
    out, found = test, []
    for k, (name, model) in enumerate(models.items()):  # one scan: each model adds a column of its own
        scored = model.transform(out)
        row = F.struct(
            F.lit(FAMILIES[name].title if name in FAMILIES else name).alias("model"),
            F.col("prediction").cast("double").alias("prediction"),
            positive_score(scored).cast("double").alias("score"),
        )
        found.append(f"_model_{k}")
        out = scored.select(*test.columns, *found[:-1], row.alias(found[-1]))
    rows = out.select(key, "label", F.inline(F.array(*found)))
    return rows.select("model", key, "label", "prediction", "score")


def classification_results(long: DataFrame) -> DataFrame:
    """One row per model with metrics, confusion matrix and status."""
    metrics = evaluation.class_metrics(evaluation.confusion(long))
    matrix = F.struct(F.col("tn").alias("TN"), F.col("fp").alias("FP"), F.col("fn").alias("FN"), F.col("tp").alias("TP"))
    return metrics.select(
        "model", "accuracy", "precision", "recall", "f1_score", matrix.alias("confusion_matrix"), F.lit("OK").alias("status")
    )


def regression_results(long: DataFrame) -> DataFrame:
    return evaluation.regression_metrics(long).select(
        "model", "rmse", "mae", "r2", "mape", F.lit("OK").alias("status")
    )


def with_failures(results: DataFrame, failures: Mapping[str, str]) -> DataFrame:
    """Failed models as status rows without metrics."""
    if not failures:
        return results
    rows = [(FAMILIES[n].title if n in FAMILIES else n, s) for n, s in failures.items()]
    failed = results.sparkSession.createDataFrame(rows, "model string, status string")
    return results.unionByName(failed, allowMissingColumns=True)
