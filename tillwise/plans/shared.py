"""Inputs several catalogue queries start from, and rounding for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import insights
from ..session import materialize
from . import tables


# Added before rounding on both sides of a comparison: exact halves, common among
# quotients of cents, then round up everywhere instead of falling either way.
TIE_SHIFT = 1e-7


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every floating column, so that summation order does not show."""
    return df.select(
        [
            F.round(F.lit(TIE_SHIFT) + F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The stored customer table, cut to the columns a query needs."""
    table = tables.customers(spark, sf_dir)
    return table.select(*columns) if columns else table


def scored_customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Stored customers with the rule-based churn probability."""
    needed = {"customer_id", "total_sales", "days_since_last_purchase", *columns}
    return insights.rule_scored(customers(spark, sf_dir, *sorted(needed)))


def clv_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored customers with lifetime-value columns, stored for the two-pass quantiles."""
    scored = scored_customers(
        spark, sf_dir, "membership_years", "total_transactions", "avg_purchase_value", "last_purchase_date"
    )
    dated = scored.withColumnRenamed("last_purchase_date", "transaction_date")
    return materialize(insights.clv_estimate(dated), "clv")
