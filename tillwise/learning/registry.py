"""The model families: name -> how to train it on ``(key, features..., label)``.

Anything with ``fit(df, features, key) -> model`` and ``model.transform(df)``
adding ``prediction`` plugs in through :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import flag
from ..operators.evaluation import best_threshold, threshold_table
from ..operators.sampling import split
from ..operators.scaling import balanced_weight
from . import boosting, clusters, descent, gradient, regression_boosting, trees
from .prep import oversample, pca_stages, polynomial_stages, vector_stages

SEED = 42


@dataclass(frozen=True)
class Family:
    name: str
    title: str
    task: str
    fit: Callable[[DataFrame, Sequence[str], str], object]


@dataclass
class TunedClassifier:
    """A probabilistic classifier with its own decision threshold."""

    model: object
    threshold: float

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df).withColumn("score", vector_to_array("probability")[1])
        return scored.withColumn("prediction", flag(F.col("score") >= self.threshold).cast("double"))


def _pipeline(stages, estimator, df: DataFrame):
    return Pipeline(stages=[*stages, estimator]).fit(df)


def linear(df, features, key):
    return descent.fit_simple(df, features, "label")


def multiple(df, features, key):
    return descent.fit_multiple(df, features, "label")


def ordinary_least_squares(df, features, key):
    return _pipeline(vector_stages(features, standardize=False), LinearRegression(solver="normal"), df)


def polynomial(df, features, key):
    return _pipeline(polynomial_stages(features, 2), LinearRegression(regParam=1e-6, maxIter=100), df)


def boosted_trees(df, features, key):
    return regression_boosting.fit_boosted(df, features)


def boosted_trees_sampled(df, features, key):
    trees = GBTRegressor(
        maxIter=50, stepSize=0.1, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED
    )
    return _pipeline(vector_stages(features, False), trees, df)


def logistic(df, features, key, l2: float = 0.0):
    return gradient.fit_logistic(df, features, l2=l2)


def tree(df, features, key):
    return trees.fit_tree(df, features)


def forest(df, features, key, count: int = 50):
    return trees.fit_forest(df, features, key, trees=count)


def forest_large(df, features, key):
    return forest(df, features, key, count=200)


def svm(df, features, key):
    return gradient.fit_hinge(df, features)


def forest_pca(df, features, key):
    many = RandomForestClassifier(numTrees=50, maxDepth=10, featureSubsetStrategy="sqrt", seed=SEED)
    return _pipeline(pca_stages(features, 10), many, df)


def svm_pca(df, features, key):
    weighted = balanced_weight(df, "label")
    return _pipeline(pca_stages(features, 10), LinearSVC(maxIter=100, regParam=0.001, weightCol="weight"), weighted)


def kmeans(df, features, key):
    return clusters.fit_kmeans(df, features)


def hierarchical(df, features, key):
    return clusters.fit_hierarchical(df, features)


def perceptron(df, features, key):
    one_layer = MultilayerPerceptronClassifier(layers=[len(features), 2], maxIter=100, seed=SEED)
    return _pipeline(vector_stages(features), one_layer, df)


def network(df, features, key):
    """64-32 network on balanced classes; its threshold is tuned on a validation share."""
    train, validation = split(df, key, 0.15, seed=SEED)
    layers = MultilayerPerceptronClassifier(layers=[len(features), 64, 32, 2], maxIter=100, seed=SEED)
    model = _pipeline(vector_stages(features), layers, oversample(train, key))
    scored = model.transform(validation).select(
        F.lit("m").alias("model"), "label", vector_to_array("probability")[1].alias("score")
    )
    tuned = best_threshold(threshold_table(scored)).first()
    return TunedClassifier(model, tuned["threshold"] if tuned else 0.5)


def stumps(df, features, key):
    return boosting.fit_stumps(df, features, "label", key)


FAMILIES: dict[str, Family] = {}


def register(name: str, title: str, task: str, fit) -> None:
    FAMILIES[name] = Family(name, title, task, fit)


for _name, _title, _task, _fit in [
    ("linear_regression", "Linear Regression (scratch)", "regression", linear),
    ("multiple_regression", "Multiple Regression (scratch)", "regression", multiple),
    ("least_squares_regression", "Multiple Regression (closed form)", "regression", ordinary_least_squares),
    ("polynomial_regression", "Polynomial Regression (scratch)", "regression", polynomial),
    ("boosted_trees_regression", "Boosted Trees", "regression", boosted_trees),
    ("boosted_trees_sampled_regression", "Boosted Trees (subsampled)", "regression", boosted_trees_sampled),
    ("logistic_regression_classification", "Logistic Regression (scratch)", "classification", logistic),
    ("decision_tree_classification", "Decision Tree (scratch)", "classification", tree),
    ("random_forest_classification", "Random Forest (scratch)", "classification", forest),
    ("random_forest_large_classification", "Random Forest (200 trees)", "classification", forest_large),
    ("svm_classification", "SVM (scratch)", "classification", svm),
    ("random_forest_pca_classification", "Random Forest + PCA (scratch)", "classification", forest_pca),
    ("svm_pca_classification", "SVM + PCA (scratch)", "classification", svm_pca),
    ("kmeans_classification", "K-Means Clustering (scratch)", "classification", kmeans),
    ("hierarchical_classification", "Agglomerative Clustering (scratch)", "classification", hierarchical),
    ("perceptron_classification", "Perceptron (scratch)", "classification", perceptron),
    ("mlp_classification", "MLP (scratch)", "classification", network),
    ("stumps_classification", "Custom Model (scratch)", "classification", stumps),
]:
    register(_name, _title, _task, _fit)


def families(task: str | None = None) -> list[Family]:
    return [f for f in FAMILIES.values() if task in (None, f.task)]
