"""Text and time-period expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col


def metric_name(model: str | Column, metric: str | Column) -> Column:
    """``Random Forest (Scratch)`` + ``f1`` -> ``random_forest_scratch_f1``."""
    base = F.translate(F.lower(as_col(model)), " ()", "_")
    return F.concat(base, F.lit("_"), as_col(metric))


def percent_text(c: str | Column, decimals: int = 1) -> Column:
    return F.concat(F.format_number(as_col(c) * 100.0, decimals), F.lit("%"))


def money_text(c: str | Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(as_col(c), decimals))


def title_text(c: str | Column) -> Column:
    """``avg_purchase_value`` -> ``Avg Purchase Value``."""
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))


def period_key(ts: str | Column, period: str = "monthly") -> Column:
    """Calendar period as text; an unknown period name means monthly."""
    ts = as_col(ts)
    if period == "yearly":
        return F.year(ts).cast("string")
    if period == "quarterly":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")
