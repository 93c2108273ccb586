"""Preparation shared by all model families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, Imputer, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.sampling import hash_bucket, BUCKETS
from ..operators.scaling import class_weights

def training_table(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Features and label as doubles; rows without a label are left out."""
    columns = [F.col(c).cast("double").alias(c) for c in features]
    return df.where(F.col(label).isNotNull()).select(*keep, *columns, F.col(label).cast("double").alias("label"))


def vector_stages(features: Sequence[str], standardize: bool = True, center: bool = True) -> list:
    """Mean imputation, assembly and, on request, standardisation; the result is ``features``."""
    filled = [f"{c}__filled" for c in features]
    stages = [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features" if standardize else "features"),
    ]
    if standardize:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=center, withStd=True))
    return stages


def prep_pipeline(features: Sequence[str], standardize: bool = True) -> Pipeline:
    return Pipeline(stages=vector_stages(features, standardize))


def expanded_width(n: int, degree: int) -> int:
    width, term = 0, 1
    for d in range(1, degree + 1):
        term = term * (n + d - 1) // d
        width += term
    return width


def polynomial_stages(features: Sequence[str], degree: int = 2) -> list:
    """Standardise, expand to all products up to a degree, standardise again."""
    return [
        *vector_stages(features)[:-1],
        StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
        PolynomialExpansion(degree=degree, inputCol="scaled", outputCol="expanded"),
        StandardScaler(inputCol="expanded", outputCol="features", withMean=True, withStd=True),
    ]


def pca_stages(features: Sequence[str], k: int = 10) -> list:
    """Centred principal components; Spark's projection does not centre by itself."""
    return [
        *vector_stages(features)[:-1],
        StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=min(k, len(features)), inputCol="scaled", outputCol="features"),
    ]


def oversample(df: DataFrame, key: str, label: str = "label", seed: int = 11) -> DataFrame:
    """Repeat positive rows until both classes weigh the same, in expectation.

    For learners without a weight column. The number of copies of a row follows
    from its key, so the outcome does not depend on the partitioning.
    """
    row = class_weights(df, label).first()
    ratio = max(1.0, row["network_positive_weight"])
    whole, part = int(ratio), ratio - int(ratio)
    extra = F.when(hash_bucket(key, seed) < round(part * BUCKETS), 1).otherwise(0)
    copies = F.when(F.col(label) == 1, F.lit(whole) + extra).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def vector_items(vector: str | Column, size: int) -> list[Column]:
    array = vector_to_array(vector)
    return [array[i] for i in range(size)]
