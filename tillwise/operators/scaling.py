"""Imputation, standardisation, target scaling, class weights, polynomial terms.

Fitted figures are one row per table. The lazy forms put that row next to the
data as a scalar subquery; ``fit_*`` returns it as a dictionary for replay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import mul

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col, clean
from ..functions.scalars import one_row
from .correlation import target_correlations


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Column means with NaN left out; 0 for a column without values."""
    row = df.agg(*[F.avg(clean(c)).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def impute(df: DataFrame, means: Mapping[str, float]) -> DataFrame:
    """Replay fitted means; a column that was not fitted gets 0 by the caller's mapping."""
    return df.withColumns({c: F.coalesce(clean(c), F.lit(float(v))) for c, v in means.items()})


def mean_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN replaced by the column mean (0 when there is none)."""
    means = one_row(df.agg(*[F.avg(clean(c)).alias(c) for c in columns]))
    filled = {c: F.coalesce(clean(c), F.col("_means")[c], F.lit(0.0)) for c in columns}
    return df.withColumn("_means", means).withColumns(filled).drop("_means")


def _mean_std(df: DataFrame, columns: Sequence[str]) -> Column:
    return one_row(
        df.agg(
            *[F.avg(clean(c)).alias(f"{c}__mean") for c in columns],
            *[F.stddev_pop(clean(c)).alias(f"{c}__std") for c in columns],
        )
    )


def _spread(stats: Column, column: str) -> Column:
    std = stats[f"{column}__std"]
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column is divided by 1."""
    s = F.col("_fit")
    scaled = {c: (clean(c) - s[f"{c}__mean"]) / _spread(s, c) for c in columns}
    return df.withColumn("_fit", _mean_std(df, columns)).withColumns(scaled).drop("_fit")


def scale_target(df: DataFrame, target: str, out: str, restored: str | None = None) -> DataFrame:
    """Standardised target and, on request, the value carried back to its own scale."""
    s = F.col("_fit")
    scaled = df.withColumn("_fit", _mean_std(df, [target])).withColumn(
        out, (clean(target) - s[f"{target}__mean"]) / _spread(s, target)
    )
    if restored:
        scaled = scaled.withColumn(restored, F.col(out) * _spread(s, target) + s[f"{target}__mean"])
    return scaled.drop("_fit")


def label_sign(label: str | Column) -> Column:
    return F.when(as_col(label) == 1, F.lit(1)).otherwise(F.lit(-1))


def polynomial_terms(columns: Sequence[str], degree: int = 2) -> dict[str, Column]:
    """Products of up to ``degree`` columns, repeats allowed, lower degrees first, no constant."""
    terms = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            terms["*".join(combo)] = reduce(mul, [F.col(c).cast("double") for c in combo])
    return terms


def polynomial_expand(df: DataFrame, columns: Sequence[str], degree: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in polynomial_terms(columns, degree).items()])


def class_weights(df: DataFrame, label: str, c: float = 1.0) -> DataFrame:
    """One row: class counts and the balance weights of the three learner kinds."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    pos, neg = F.col("positives"), F.col("negatives")
    return counts.select(
        "positives", "negatives",
        (F.lit(c) * F.coalesce(F.try_divide(neg, pos), F.lit(1.0))).alias("margin_positive_cost"),
        F.lit(c).alias("margin_negative_cost"),
        F.coalesce(F.try_divide(neg, pos), F.lit(1.0)).alias("network_positive_weight"),
        F.coalesce(F.try_divide(F.lit(0.5), pos), F.lit(0.0)).alias("boosting_positive_weight"),
        F.coalesce(F.try_divide(F.lit(0.5), neg), F.lit(0.0)).alias("boosting_negative_weight"),
    )


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight column that gives both classes the same total."""
    w = one_row(class_weights(df, label))
    value = F.when(F.col(label) == 1, F.col("_w")["network_positive_weight"]).otherwise(F.lit(1.0))
    return df.withColumn("_w", w).withColumn(out, value).drop("_w")


def best_feature(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The feature with the largest absolute correlation; constant columns count 0."""
    rows = target_correlations(df, features, target, keep_undefined=True)
    strength = F.abs(F.coalesce("correlation", F.lit(0.0)))
    return rows.orderBy(strength.desc(), "feature").limit(1).select(
        "feature", F.coalesce("correlation", F.lit(0.0)).alias("correlation")
    )


def fit_fill_values(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, float]:
    """Median or mode of each column for :func:`impute`."""
    from .quantiles import exact_quantiles

    long = df.select([clean(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    if strategy == "median":
        rows = exact_quantiles(long, "value", [0.5], by=["column"]).select("column", F.col("quantile").alias("v"))
    elif strategy == "mode":
        counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        # most frequent value; the smallest one wins a tie
        rows = counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("v"))
    else:
        raise ValueError("strategy must be 'median' or 'mode'")
    return {r["column"]: r["v"] for r in rows.collect()}
