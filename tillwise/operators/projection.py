"""Column selection, filters and schema alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import as_col

# Identifier, target, date and zip-code columns of the retail table.
ID_COLUMNS = ["customer_id", "transaction_id", "product_id", "promotion_id"]
TARGET_COLUMNS = ["total_sales", "churned", "clv_per_year"]
DATE_COLUMNS = [
    "transaction_date", "last_purchase_date", "product_manufacture_date",
    "product_expiry_date", "promotion_start_date", "promotion_end_date",
]
ZIP_COLUMNS = ["customer_zip_code", "store_zip_code"]
# Names the geographic summary is published under.
GEO_NAMES = {
    "customer_city": "city",
    "customer_state": "country",
    "total_sales": "avg_revenue",
    "customer_count": "customers",
}


def drop_ids(df: DataFrame) -> DataFrame:
    return df.drop(*ID_COLUMNS)


def drop_targets(df: DataFrame) -> DataFrame:
    return df.drop(*TARGET_COLUMNS)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def present(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def feature_columns(df: DataFrame, drop: Iterable[str] = ("total_sales", "churned")) -> list[str]:
    drop = set(drop)
    return [c for c in df.columns if c not in drop]


def analysis_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no identifier, date or zip code."""
    excluded = {*ID_COLUMNS, *DATE_COLUMNS, *ZIP_COLUMNS}
    return [c for c in numeric_columns(df) if c not in excluded]


def rename(df: DataFrame, names: Mapping[str, str] = GEO_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def names_with_prefix(names: Iterable[str], prefix: str) -> list[str]:
    """Values encoded in dummy-column names, sorted and without repeats."""
    return sorted({n[len(prefix):] for n in names if n.startswith(prefix)})


def sorted_levels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def customer_filter(
    df: DataFrame,
    age_min: int | None = None,
    age_max: int | None = None,
    income_level: str | None = None,
    min_purchase_value: float | None = None,
    age: str = "age",
    income: str = "income_bracket",
    value: str = "avg_purchase_value",
) -> DataFrame:
    """Optional conditions joined with AND; none given keeps every row."""
    tests: list[Column] = []
    if age_min is not None:
        tests.append(F.col(age) >= age_min)
    if age_max is not None:
        tests.append(F.col(age) <= age_max)
    if income_level is not None:
        tests.append(F.col(income) == income_level)
    if min_purchase_value is not None:
        tests.append(F.col(value) >= min_purchase_value)
    return df.where(reduce(and_, tests)) if tests else df


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected columns, in order, as doubles; absent or null becomes 0."""
    columns = [
        (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in expected
    ]
    return df.select(*keep, *columns)


def coerce_numeric(c: str | Column) -> Column:
    """Text to double; what is no number becomes 0."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))


def resolve_features(
    saved: Sequence[str] | None, count: int | None, available: Sequence[str], known: Sequence[str]
) -> list[str]:
    """Feature names of a model: its saved list, the known list by size, else all columns."""
    if saved:
        return list(saved)
    if count is not None and count == len(known):
        return list(known)
    return list(available)
