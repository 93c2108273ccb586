"""Pearson correlations: matrix, target ranking, significance, labels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col, clean

# Lower bounds of the strength classes and p-value marks.
STRENGTHS = [(0.7, "very strong"), (0.5, "strong"), (0.3, "moderate")]
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]

#: A spread below this share of the summed squares is rounding: the side counts as constant.
CONSTANT = 1e-12


def pair_sums(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy, endless)`` for each column of ``left`` with each of ``right``.

    Sums run over the rows where both values are present, at every width: a
    partition multiplies its value, square and presence matrices, and gives out
    one row per pair. Values are taken from their column's minimum on, so that
    squares stay small and a constant column sums to exact zeros.
    """
    used = list(dict.fromkeys([*left, *right]))
    table = df.select([clean(c).alias(str(k)) for k, c in enumerate(used)])
    lows = table.agg(*[F.min(str(k)) for k in range(len(used))]).first()
    shift = [x if x is not None and math.isfinite(x) else 0.0 for x in lows]
    x_at, y_at = [used.index(c) for c in left], [used.index(c) for c in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((7, len(x_at), len(y_at)))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float)
                there = ~np.isnan(values)
                endless = np.isinf(values)
                values = np.where(there & ~endless, values - shift, 0.0)
                m, e = there.astype(float), endless.astype(float)
                x, y, mx, my = values[:, x_at], values[:, y_at], m[:, x_at], m[:, y_at]
                total += [
                    mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y,
                    e[:, x_at].T @ my + mx.T @ e[:, y_at],
                ]
        i, j = (k.ravel() for k in np.indices(total.shape[1:]))
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t.ravel()) for t in total)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy", "endless"])

    sums = "n double, sx double, sy double, sxx double, syy double, sxy double, endless double"
    parts = table.mapInArrow(run, f"i int, j int, {sums}")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "endless")])


def cross_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """``(i, j, n, correlation)`` of each column of ``left`` with each of ``right``; a constant side gives null."""
    s = pair_sums(df, left, right)
    x_spread = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    y_spread = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    both = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    sound = (F.col("endless") == 0) & (x_spread > CONSTANT * F.col("sxx")) & (y_spread > CONSTANT * F.col("syy"))
    r = F.when(sound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / (F.sqrt(x_spread) * F.sqrt(y_spread)))))
    return s.select("i", "j", F.col("n").cast("long").alias("n"), r.alias("correlation"))


def _name(names: Sequence[str], at: str) -> Column:
    """Look up a text by its number."""
    return F.lit(list(names))[F.col(at)]


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long upper triangle ``(i, j, feature_1, feature_2, correlation)``, pairwise complete at every width."""
    columns = list(columns)
    rows = cross_correlations(df, columns, columns).where("i < j")
    return rows.select(
        "i", "j", _name(columns, "i").alias("feature_1"), _name(columns, "j").alias("feature_2"), "correlation"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """d x d matrix as a NumPy array (d columns, independent of the row count); undefined entries are NaN."""
    columns = list(columns)
    matrix = np.full((len(columns), len(columns)), np.nan)
    for r in cross_correlations(df, columns, columns).where("correlation is not null").collect():
        matrix[r["i"], r["j"]] = r["correlation"]
    return matrix


def target_correlations(
    df: DataFrame, features: Sequence[str], target: str, keep_undefined: bool = False
) -> DataFrame:
    """Correlation of each feature with the target in one pass; undefined ones are dropped."""
    rows = cross_correlations(df, list(features), [target]).select(_name(features, "i").alias("feature"), "correlation")
    return rows if keep_undefined else rows.where("correlation is not null")


def strongest(df: DataFrame, features: Sequence[str], target: str, n: int = 10) -> DataFrame:
    return target_correlations(df, features, target).orderBy(F.abs("correlation").desc(), "feature").limit(n)


def strength(r: str | Column) -> Column:
    size = F.abs(as_col(r))
    chain = F.when(size > STRENGTHS[0][0], STRENGTHS[0][1])
    for bound, name in STRENGTHS[1:]:
        chain = chain.when(size > bound, name)
    return chain.otherwise("weak")


def direction(r: str | Column) -> Column:
    return F.when(as_col(r) > 0, "positive").otherwise("negative")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return h
    raise ArithmeticError(f"the incomplete beta function did not converge for a={a}, b={b}, x={x}")


def _log_half_ratio(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)), exact to rounding for every size of ``a``."""
    down = 0.0
    while a < 60.0:  # each step up multiplies the ratio by (a + 1/2) / a
        down -= math.log1p(0.5 / a)
        a += 1.0
    return down + 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b = dof / 2.0, 0.5
    away = t * t / (dof + t * t)  # 1 - x, without cancellation
    if away == 0.0:
        return 1.0
    log_x = -math.log1p(t * t / dof)
    front = math.exp(_log_half_ratio(a) - 0.5 * math.log(math.pi) + a * log_x + 0.5 * math.log(away))
    if math.exp(log_x) < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, math.exp(log_x)) / a
    return 1.0 - front * _beta_fraction(b, a, away) / b


def t_statistics(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """r, n and t over pairwise-complete rows, one pass for all features."""
    rows = (
        cross_correlations(df, list(features), [target])
        .where("correlation is not null")
        .select(_name(features, "i").alias("feature"), "correlation", "n")
    )
    r = F.col("correlation")
    return rows.withColumn("t", r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r)))


def significance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """:func:`t_statistics` with the two-sided p-value and its star mark.

    One row per feature comes to the driver, where the t distribution is evaluated.
    """
    tested = t_statistics(df, features, target)
    rows = [(*r, two_sided_p(r["t"], r["n"] - 2)) for r in tested.collect()]
    table = df.sparkSession.createDataFrame(
        rows, "feature string, correlation double, n long, t double, p_value double"
    )
    mark = F.when(F.col("p_value") < STARS[0][0], STARS[0][1])
    for bound, star in STARS[1:]:
        mark = mark.when(F.col("p_value") < bound, star)
    return table.withColumn("stars", mark.otherwise(""))


def cross_target(df: DataFrame, features: Sequence[str], first: str, second: str, n: int = 10) -> DataFrame:
    """Features by the mean of their absolute correlations with two targets, in one pass."""
    features = list(features)
    rows = cross_correlations(df, features, [first, second]).select(
        _name(features, "i").alias("feature"), (F.col("j") == 0).alias("is_first"), F.abs("correlation").alias("size")
    )
    both = rows.groupBy("feature").agg(
        F.max(F.when(F.col("is_first"), F.col("size"))).alias(f"abs_{first}"),
        F.max(F.when(~F.col("is_first"), F.col("size"))).alias(f"abs_{second}"),
    )
    mean = (F.col(f"abs_{first}") + F.col(f"abs_{second}")) / 2
    return both.withColumn("mean_abs", mean).na.drop().orderBy(F.col("mean_abs").desc(), "feature").limit(n)


def top_and_bottom(correlations: DataFrame, n: int = 10) -> DataFrame:
    """Most positive and most negative correlations."""
    top = correlations.orderBy(F.col("correlation").desc(), "feature").limit(n)
    bottom = correlations.orderBy("correlation", "feature").limit(n)
    return top.select(F.lit("top").alias("kind"), "*").unionByName(
        bottom.select(F.lit("bottom").alias("kind"), "*")
    )


def named(correlations: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Correlation of each wanted feature, null where it was not measured."""
    names = correlations.sparkSession.createDataFrame([(w,) for w in wanted], "feature string")
    return names.join(correlations, "feature", "left")
