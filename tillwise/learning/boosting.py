"""Boosted decision stumps with class-balanced weights.

Every feature is cut once into at most ten bins by nine quantile thresholds.
A boosting round is then one aggregation: the weight per (feature, bin, class),
with map-side combine, gives the error of every stump. Its result has at most
20 numbers per feature, so picking the stump happens on the driver.

Weights are never stored per round. They follow from the score so far, which is
a column plus the few stumps found since it was last written; the written table
bounds both the expression and the lineage, and survives the loss of executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clean, flag, sigmoid, total
from ..operators.evaluation import best_threshold, threshold_table
from ..operators.quantiles import exact_quantiles
from ..operators.sampling import split
from ..operators.scaling import fit_means, impute, label_sign
from ..operators.stats import long_values
from ..session import Stages

CUTS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FOLD_EVERY = 10


@dataclass(frozen=True)
class Stump:
    """+1 at or above the threshold, -1 below; the polarity may turn it round."""

    feature: str
    threshold: float
    polarity: int
    alpha: float

    def vote(self, value: Column) -> Column:
        up = F.lit(float(self.polarity))
        return F.when(value >= self.threshold, up).otherwise(-up)


@dataclass
class StumpModel:
    means: dict[str, float]
    stumps: list[Stump]
    threshold: float = 0.5

    def score(self) -> Column:
        values = {f: F.coalesce(clean(f), F.lit(m)) for f, m in self.means.items()}
        return total([F.lit(s.alpha) * s.vote(values[s.feature]) for s in self.stumps])

    def transform(self, df: DataFrame) -> DataFrame:
        p = sigmoid(F.lit(2.0) * self.score())
        return df.withColumn("score", p).withColumn(
            "prediction", flag(F.col("score") >= self.threshold).cast("double")
        )


def quantile_thresholds(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Distinct quantile cuts per feature, at most nine each. Hand in a stored table."""
    rows = exact_quantiles(long_values(df, features, "feature"), "value", CUTS, by=["feature"]).collect()
    return {f: sorted({r["quantile"] for r in rows if r["feature"] == f}) for f in features}


def bin_of(column: str, thresholds: Sequence[float]) -> Column:
    """How many thresholds a column reaches."""
    return F.expr(" + ".join([f"if(`{column}` >= {t!r}D, 1, 0)" for t in thresholds] or ["0"]))


def start_weight(label: str, positives: int, negatives: int) -> str:
    """Half the total weight for each class, as SQL."""
    pos = 0.5 / positives if positives else 0.0
    neg = 0.5 / negatives if negatives else 0.0
    return f"if(`{label}` = 1, {pos!r}D, {neg!r}D)"


def bin_weights(binned: DataFrame, features: Sequence[str], weight: str, sign: str) -> DataFrame:
    """``(feature, bin, plus, minus)``: weight of both classes per bin of every feature.

    ``weight`` and ``sign`` are SQL expressions.
    """
    options = ", ".join(f"struct('{f}' AS feature, `bin__{f}` AS bin)" for f in features)
    return (
        binned.selectExpr(f"{weight} AS _w", f"{sign} AS _s", f"inline(array({options}))")
        .groupBy("feature", "bin")
        .agg(
            F.expr("sum(if(_s = 1, _w, 0D)) AS plus"),
            F.expr("sum(if(_s = -1, _w, 0D)) AS minus"),
        )
    )


def stump_errors(weights: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Weighted error of each stump ``(feature, threshold, polarity, error)``.

    Threshold i votes +1 for bins above i, so its error is the plus weight at or
    below i and the minus weight above it. The windows run over at most ten bins.
    """
    cuts = [(f, i, t) for f, ts in thresholds.items() for i, t in enumerate(ts)]
    table = F.broadcast(  # nine rows per feature at most
        weights.sparkSession.createDataFrame(cuts, "feature string, i int, threshold double")
    )
    order = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    cumulated = weights.select(
        "feature", "bin",
        F.sum("plus").over(order).alias("_p"), F.sum("minus").over(order).alias("_m"),
        F.sum("plus").over(whole).alias("_ap"), F.sum("minus").over(whole).alias("_am"),
    )
    # a bin may be empty, so the last bin at or below i is looked up
    best = cumulated.join(table, "feature").groupBy("feature", "i", "threshold", "_ap", "_am").agg(
        F.coalesce(F.max_by(F.when(F.col("bin") <= F.col("i"), F.col("_p")),
                            F.when(F.col("bin") <= F.col("i"), F.col("bin"))), F.lit(0.0)).alias("_p"),
        F.coalesce(F.max_by(F.when(F.col("bin") <= F.col("i"), F.col("_m")),
                            F.when(F.col("bin") <= F.col("i"), F.col("bin"))), F.lit(0.0)).alias("_m"),
    )
    error = F.col("_p") + F.col("_am") - F.col("_m")
    return best.select(
        "feature", "threshold",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("polarity"), error.alias("error")),
                F.struct(F.lit(-1).alias("polarity"), (F.col("_ap") + F.col("_am") - error).alias("error")),
            )
        ),
    )


def pick_stump(rows, features: Sequence[str], thresholds: dict[str, list[float]]):
    """The stump with the least share of wrong weight, from at most ten bin rows per feature.

    Ties go to the earlier feature, the lower threshold, the positive polarity; errors
    that differ by the order of summation only count as ties.
    """
    best = None
    for f in features:
        bins = [r for r in rows if r["feature"] == f]
        mass = sum(r["plus"] + r["minus"] for r in bins)
        for i, t in enumerate(thresholds[f]):
            wrong = sum(r["plus"] if r["bin"] <= i else r["minus"] for r in bins)
            for polarity, error in ((1, wrong / mass), (-1, 1.0 - wrong / mass)):
                if best is None or round(error, 12) < round(best[3], 12):
                    best = (f, t, polarity, error)
    return best


def first_round(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Errors of all stumps under the starting weights. Hand in a stored table."""
    thresholds = quantile_thresholds(df, features)
    n = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    binned = df.select(
        label, *[bin_of(f, thresholds[f]).alias(f"bin__{f}") for f in features]
    )
    weights = bin_weights(binned, features, start_weight(label, n[0], n[1]), f"if(`{label}` = 1, 1, -1)")
    return stump_errors(weights, thresholds)


def fit_stumps(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    rounds: int = 100,
    lr: float = 0.01,
    validation_share: float = 0.15,
    seed: int = 42,
    fold_every: int = FOLD_EVERY,
    start: StumpModel | None = None,
) -> StumpModel:
    """Train on all but the validation share, then tune the threshold on it.

    ``start`` goes on from a model: its means are kept, the weights follow from its stumps, and ``rounds``
    more are added, as if training had not stopped. The stages written on the way are removed.
    """
    features = list(features)
    if start is not None and list(start.means) != features:
        raise ValueError("the model to go on from was trained on other features")
    with Stages(df.sparkSession) as filled_stage, Stages(df.sparkSession) as states:
        means = start.means if start else fit_means(df, features)
        filled = impute(df, means).select(key, *features, label)
        train, validation = split(filled_stage.keep(filled, "boosting"), key, validation_share, seed)
        thresholds = quantile_thresholds(train, features)
        n = train.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
        sign = label_sign(label)
        stumps: list[Stump] = list(start.stumps) if start else []
        base = F.when(sign == 1, F.lit(math.log(0.5 / max(n[0], 1)))).otherwise(math.log(0.5 / max(n[1], 1)))
        so_far = StumpModel(means, stumps).score() if stumps else F.lit(0.0)
        state = states.keep(
            train.select(
                *[bin_of(f, thresholds[f]).cast("tinyint").alias(f"bin__{f}") for f in features],
                sign.cast("tinyint").alias("sign"),
                (base - sign * so_far).alias("logw"),
            ),
            "stumps",
        )
        recent: list[Stump] = []
        wanted = len(stumps) + rounds
        while len(stumps) < wanted:
            rows = bin_weights(state, features, f"exp({_log_weight(recent, thresholds)})", "sign").collect()
            best = pick_stump(rows, features, thresholds)
            if best is None:
                break
            feature, threshold, polarity, error = best
            error = min(max(error, 1e-12), 1.0 - 1e-12)
            stump = Stump(feature, threshold, polarity, 0.5 * math.log((1.0 - error) / error) * lr)
            stumps.append(stump)
            recent.append(stump)
            if len(recent) == fold_every and len(stumps) < wanted:
                state = states.keep(state.withColumn("logw", F.expr(_log_weight(recent, thresholds))), "stumps")
                states.drop(but=1)  # a state is one table, whatever the number of rounds
                recent = []
        model = StumpModel(means, stumps)
        if stumps:
            scored = model.transform(validation).select(F.lit("m").alias("model"), F.col(label).alias("label"), "score")
            tuned = best_threshold(threshold_table(scored)).first()
            model.threshold = tuned["threshold"] if tuned else 0.5
    return model


def _log_weight(recent: Sequence[Stump], thresholds: dict[str, list[float]]) -> str:
    """Log weight after the recent stumps, as SQL; finding the next one needs no normalisation."""
    votes = [
        f"if(`bin__{s.feature}` > {thresholds[s.feature].index(s.threshold)}, "
        f"{s.polarity * s.alpha!r}D, {-s.polarity * s.alpha!r}D)"
        for s in recent
    ]
    return f"logw - sign * ({' + '.join(votes)})" if votes else "logw"
