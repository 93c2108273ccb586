"""One-row aggregates used next to row-level data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(aggregate: DataFrame) -> Column:
    """The single row of a global aggregate as a struct-valued scalar subquery.

    Spark plans it as one subquery whose result is shipped with the tasks, so
    rows meet global figures without a join.
    """
    return aggregate.select(F.struct("*").alias("row")).scalar()
