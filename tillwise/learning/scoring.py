"""Batch scoring: a table of requests in, one prediction row per request out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import sigmoid
from ..operators.insights import rule_scored
from .clusters import MarginModel

# The order in which saved models are tried for churn scores.
CHURN_MODEL_ORDER = [
    "logistic_regression_classification", "random_forest_classification",
    "svm_classification", "decision_tree_classification",
]


def score(model, df: DataFrame, keys: Sequence[str], task: str = "classification") -> DataFrame:
    """``(*keys, prediction[, label_text, probability])``; probability is 0.5 where a model has none.

    A margin between clusters becomes a probability by the logistic function, with one half at its threshold.
    """
    out = model.transform(df)
    if task == "regression":
        return out.select(*keys, F.col("prediction").cast("double").alias("prediction"))
    return out.select(
        *keys,
        F.col("prediction").cast("int").alias("prediction"),
        F.when(F.col("prediction") == 1, "Churn").otherwise("Retain").alias("label_text"),
        (sigmoid(F.col("score") - model.threshold) if isinstance(model, MarginModel) else positive_score(out)).alias("probability"),
    )


def positive_score(scored: DataFrame):
    """Probability of the positive class of a transformed table."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return F.col("score") if "score" in scored.columns else F.lit(0.5)


def churn_scored(df: DataFrame, models: dict[str, object], keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Churn probability from the first available model, else from the two-rule score."""
    for name in CHURN_MODEL_ORDER:
        if name in models:
            out = models[name].transform(df)
            p = positive_score(out)
            if "probability" not in out.columns and "score" not in out.columns:
                p = F.col("prediction").cast("double")
            return out.select(*df.columns, p.alias("churn_probability"))
    return rule_scored(df)
