"""What-if analysis: move one feature at a time and score again.

All requests, features and steps are scored as one table. With a column formula
the four steps of a feature are an array on the request's own row, so nothing is
shuffled. With a model a request expands to four rows per feature (a fixed
factor, by ``explode``), and the impacts are reduced per request and feature.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clean, cleaned
from ..functions.scalars import one_row

# Steps in standard deviations.
STEPS = [(-2.0, "-2σ"), (-1.0, "-1σ"), (1.0, "+1σ"), (2.0, "+2σ")]

Scorer = Callable[[Mapping[str, Column]], Column]


def _with_stats(requests: DataFrame, features: Sequence[str], stats_from: DataFrame | None) -> DataFrame:
    """Put spread and range of the features next to the rows."""
    source = requests if stats_from is None else stats_from
    stats = one_row(
        source.agg(
            *[F.stddev_samp(clean(f)).alias(f"{f}__std") for f in features],
            *[F.min(clean(f)).alias(f"{f}__min") for f in features],
            *[F.max(clean(f)).alias(f"{f}__max") for f in features],
        )
    )
    return cleaned(requests).withColumn("_stats", stats)


def _moved(feature: str, step: float) -> Column:
    """The feature moved by some standard deviations, kept inside the observed range."""
    s = F.col("_stats")
    moved = F.col(feature).cast("double") + F.lit(step) * s[f"{feature}__std"]
    bound = s[f"{feature}__min" if step < 0 else f"{feature}__max"].cast("double")
    kept = F.greatest(moved, bound) if step < 0 else F.least(moved, bound)
    return F.when(F.col(feature).isNotNull(), kept)


def variations(requests: DataFrame, features: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """Rows ``(*request, feature, variation, value)``.

    Spread and range come from ``stats_from`` (default: the requests themselves).
    """
    options = [
        F.struct(F.lit(f).alias("feature"), F.lit(name).alias("variation"), _moved(f, step).alias("value"))
        for f in features
        for step, name in STEPS
    ]
    return _with_stats(requests, features, stats_from).select(*requests.columns, F.inline(F.array(*options)))


def varied_columns(features: Sequence[str]) -> dict[str, Column]:
    """Each feature with its own varied value swapped in."""
    return {
        f: F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f).cast("double")) for f in features
    }


def impacts(
    requests: DataFrame,
    features: Sequence[str],
    scorer: Scorer,
    key: str,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Largest, mean and spread of the change per request and feature, for a column formula."""
    own = {f: F.col(f).cast("double") for f in features}
    original = scorer(own)
    rows = _with_stats(requests, features, stats_from).select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.array(
                            *[F.abs(scorer({**own, f: _moved(f, step)}) - original) for step, _ in STEPS]
                        ).alias("_i"),
                    )
                    for f in features
                ]
            )
        ),
    )
    i = F.col("_i")
    mean = sum((i[k] for k in range(1, len(STEPS))), i[0]) / len(STEPS)
    return rows.select(
        key, "feature",
        F.array_max(i).alias("max_impact"),
        mean.alias("avg_impact"),
        (F.array_max(i) - F.array_min(i)).alias("sensitivity"),
    )


def model_impacts(
    requests: DataFrame,
    features: Sequence[str],
    model,
    key: str,
    prediction: Column,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """The same for a fitted pipeline: one ``transform`` scores the requests, one every variation."""
    # the first prediction rides on the row, so nothing is joined
    scored = model.transform(requests).select(*requests.columns, prediction.alias("_original"))
    varied = variations(scored, features, requests if stats_from is None else stats_from)
    changed = model.transform(varied.withColumns(varied_columns(features)))
    return summarize(changed.select(key, "feature", F.abs(prediction - F.col("_original")).alias("impact")), key)


def summarize(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "feature").agg(
        F.max("impact").alias("max_impact"),
        F.avg("impact").alias("avg_impact"),
        (F.max("impact") - F.min("impact")).alias("sensitivity"),
    )


def most_and_least_sensitive(impact_rows: DataFrame, key: str) -> DataFrame:
    return impact_rows.groupBy(key).agg(
        F.max_by("feature", "max_impact").alias("most_sensitive_feature"),
        F.min_by("feature", "max_impact").alias("least_sensitive_feature"),
        (F.count("*") * len(STEPS)).alias("total_variations_tested"),
    )
