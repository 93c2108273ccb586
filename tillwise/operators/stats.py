"""Column profiles and group statistics; each table is scanned as few times as the statistic allows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import as_col, clean, cleaned
from ..functions.scalars import one_row
from .quantiles import exact_quantiles


def per_column(
    df: DataFrame, columns: Sequence[str], stats: Mapping[str, Callable[[str], Column]], name: str = "column"
) -> DataFrame:
    """One row per column with the given aggregates, all computed in one pass."""
    structs = [
        F.struct(F.lit(c).alias(name), *[fn(c).alias(s) for s, fn in stats.items()]) for c in columns
    ]
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))




def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage (two decimals) per column; NaN counts as null."""
    columns = list(columns or df.columns)
    counted = per_column(
        cleaned(df), columns, {"null_count": lambda c: F.count_if(F.col(c).isNull()), "rows": lambda c: F.count(F.lit(1))}
    )
    pct = F.round(F.coalesce(F.try_divide(F.col("null_count") * 100.0, "rows"), F.lit(0.0)), 2)
    return counted.select("column", "null_count", pct.alias("null_pct"))


def total_missing(df: DataFrame) -> DataFrame:
    """Missing values in the whole table and the columns that have any."""
    profile = null_profile(df)
    return profile.agg(
        F.sum("null_count").alias("total_nulls"), F.count_if(F.col("null_count") > 0).alias("columns_with_nulls")
    )


def long_values(df: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    return df.select([clean(c).alias(c) for c in columns]).unpivot([], list(columns), name, "value")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample std, min and max of numeric columns in one pass."""
    return per_column(
        df,
        columns,
        {
            "mean": lambda c: F.avg(clean(c)),
            "std": lambda c: F.stddev_samp(clean(c)),
            "min": lambda c: F.min(clean(c)),
            "max": lambda c: F.max(clean(c)),
        },
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`moments` plus the exact median. Hand in a stored table."""
    median = exact_quantiles(long_values(df, columns), "value", [0.5], by=["column"]).select(
        "column", F.col("quantile").alias("median")
    )
    return moments(df, columns).join(median, "column", "left")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max. Hand in a stored table."""
    quartiles = (
        exact_quantiles(long_values(df, columns), "value", [0.25, 0.5, 0.75], by=["column"])
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
               for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    counts = per_column(df, columns, {"count": lambda c: F.count(clean(c))})
    return (
        counts.join(moments(df, columns), "column")
        .join(quartiles, "column", "left")
        .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def numeric_info(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max and mean per numeric column."""
    return per_column(
        df,
        columns,
        {"min": lambda c: F.min(clean(c)), "max": lambda c: F.max(clean(c)), "mean": lambda c: F.avg(clean(c))},
        name="feature",
    )


def level_info(df: DataFrame, columns: Sequence[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` distinct levels per text column, in order, one row each.

    The rank filter is applied per task before the shuffle, so a column with
    very many levels ships no more than ``limit`` of them per task.
    """
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "level"
    )
    order = Window.partitionBy("feature").orderBy("level")
    return (
        long.where("level is not null")
        .distinct()
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )


def value_counts(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Absolute and relative frequency of each present value. The total is summed from the counts."""
    counts = cleaned(df.select(F.col(column).alias(out))).where(F.col(out).isNotNull()).groupBy(out).agg(F.count("*").alias("count"))
    return summed_shares(counts, out)


def summed_shares(counts: DataFrame, name: str) -> DataFrame:
    """``(name, count)`` rows with each one's share of all counts."""
    n = one_row(counts.agg(F.sum("count").alias("n")))
    return counts.withColumn("_n", n).select(name, "count", (F.col("count") / F.col("_n")["n"]).alias("share"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    y = clean(target)
    return df.agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std_sample"), F.stddev_pop(y).alias("std_population")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def group_means(df: DataFrame, by: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.groupBy(by).agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in columns])


def box_summary(df: DataFrame, by: str, column: str) -> DataFrame:
    """Five-number summary per group. Hand in a stored table."""
    names = {0.0: "min", 0.25: "q25", 0.5: "median", 0.75: "q75", 1.0: "max"}
    points = exact_quantiles(df, as_col(column), list(names), by=[by])
    return points.groupBy(by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )
