"""Numeric column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(c: str | Column) -> Column:
    """A denominator with zero replaced by one."""
    c = as_col(c)
    return F.when(c == 0, F.lit(1.0)).otherwise(c.cast("double"))


def at_least_one(c: str | Column) -> Column:
    return F.greatest(F.lit(1.0), as_col(c).cast("double"))


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    """num / den, and 0 where the denominator is 0 or either side is null."""
    return F.coalesce(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")), F.lit(0.0))


def clip(c: str | Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(as_col(c).isNotNull(), F.least(F.greatest(as_col(c), low), high))


def sigmoid(c: str | Column) -> Column:
    """Logistic function with the argument clipped to +-30."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(c, -30.0, 30.0)))


def relu(c: str | Column) -> Column:
    return F.when(as_col(c).isNotNull(), F.greatest(as_col(c), F.lit(0.0)))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def total(columns: list[Column]) -> Column:
    return reduce(add, columns, F.lit(0.0))


def clean(c: str | Column) -> Column:
    """NaN counted as null."""
    c = as_col(c).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def cleaned(df: DataFrame) -> DataFrame:
    """The table with NaN counted as null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean(F.col(f"`{c}`")) for c in floats}) if floats else df


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null where either side is constant.

    ``corr`` raises on a constant column in ANSI mode, hence the quotient.
    """
    x, y = clean(x), clean(y)
    paired_x = F.when(y.isNotNull(), x)
    paired_y = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(paired_x) * F.stddev_pop(paired_y))
