"""Catalogue: missing values (null and NaN, derived from the tables) and wide correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..operators import correlation, insights, quality, stats, whatif
from . import insight_queries, stat_queries, tables
from .oracle_base import C360, SCORED, with_
from .shared import rounded

NAN = float("nan")
CORRELATED = stat_queries.CORRELATED
#: Each base column in three versions: whole, with nulls by one condition, and with NaN by another.
HOLES = {"": None, "_no_debt": "acct_balance >= 0", "_dear": "unit_price > 2500"}
WIDE = [c + suffix for suffix in HOLES for c in CORRELATED]


def _wide(spark, d):
    base = tables.customers(spark, d)
    marks = {"_no_debt": F.lit(None).cast("double"), "_dear": F.lit(NAN)}
    return base.select(
        *[
            (F.when(F.expr(test), F.col(c).cast("double")).otherwise(marks[suffix]) if test else F.col(c).cast("double")).alias(c + suffix)
            for suffix, test in HOLES.items()
            for c in CORRELATED
        ]
    )


def _nan_where(spark, d, column, test, *more):
    """Customers whose ``column`` is NaN where a condition holds."""
    value = F.when(F.expr(test), F.lit(NAN)).otherwise(F.col(column).cast("double"))
    return tables.customers(spark, d).select(*more, value.alias(column))


QUERIES = {
    "corr_wide": lambda spark, d: rounded(correlation.correlation_pairs(_wide(spark, d), WIDE).drop("i", "j"), 6),
    "null_profile_nan": lambda spark, d: stats.null_profile(
        _nan_where(spark, d, "acct_balance", "acct_balance < 0", "customer_id", "unit_price")
    ),
    "dq_ranges_nan": lambda spark, d: quality.range_findings(
        _nan_where(spark, d, "acct_balance", "acct_balance < -500"),
        [quality.RangeRule("acct_balance", low=0.0, high=9000.0)],
    ),
    "imbalance_nulls": lambda spark, d: rounded(
        quality.imbalance(
            tables.customers(spark, d).select(F.when(F.col("acct_balance") >= 0, F.col("churned")).alias("label")), "label"
        ), 6,
    ),
    "revenue_at_risk_nan": lambda spark, d: rounded(
        insights.revenue_at_risk(
            insights.rule_scored(_nan_where(spark, d, "total_sales", "acct_balance < 0", "days_since_last_purchase"))
        ), 1, avg_churn_probability=4,
    ),
    "geo_city_nan": lambda spark, d: rounded(
        insights.geo_cities(_nan_where(spark, d, "total_sales", "acct_balance < 0", "customer_city", "customer_state", "churned")), 2
    ),
    "sigmoid_nulls": lambda spark, d: rounded(
        tables.customers(spark, d).select(
            "customer_id", sigmoid(F.nullif("website_visits", F.lit(0)) / 10.0 - 2.0).alias("activity")
        ), 6,
    ),
    "what_if_nulls": lambda spark, d: rounded(
        whatif.impacts(
            _nan_where(spark, d, "unit_price", "acct_balance < 0", "customer_id", "quantity", "discount_applied"),
            ["quantity", "unit_price", "discount_applied"],
            lambda c: c["quantity"] * c["unit_price"] * (1 - c["discount_applied"]),
            key="customer_id",
        ), 2,
    ),
}


def _holes(column: str, base: str = "c360") -> str:
    return f", holes AS (SELECT * REPLACE (CASE WHEN acct_balance < 0 THEN NULL ELSE {column} END AS {column}) FROM {base})"


def _null_row(column: str, count: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", {count} AS null_count, "
        f"floor({count} * 10000.0::double / count(*) + 0.5::double) / 100 AS null_pct FROM c360"
    )


_WIDE_COLUMNS = ", ".join(
    (f"CASE WHEN {test} THEN {c} END" if test else c) + f"::double AS {c}{suffix}" for suffix, test in HOLES.items() for c in CORRELATED
).replace("END::double", "END")
_WIDE_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]]
_CORRS = ", ".join(f"corr({a}, {b})" for a, b in _WIDE_PAIRS)

ORACLES = {
    "corr_wide": with_(
        C360 + f", w AS (SELECT {_WIDE_COLUMNS} FROM c360)",
        f"SELECT feature_1, feature_2, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS correlation FROM ("
        f"SELECT unnest({[a for a, _ in _WIDE_PAIRS]}) AS feature_1, unnest({[b for _, b in _WIDE_PAIRS]}) AS feature_2, "
        f"unnest([{_CORRS}]) AS r FROM w)",
    ),
    "null_profile_nan": with_(
        C360,
        " UNION ALL ".join([
            _null_row("customer_id", "count(*) FILTER (customer_id IS NULL)"),
            _null_row("unit_price", "count(*) FILTER (unit_price IS NULL)"),
            _null_row("acct_balance", "count(*) FILTER (acct_balance IS NULL OR acct_balance < 0)"),
        ]),
    ),
    "dq_ranges_nan": with_(
        C360,
        ", v AS (SELECT count(*) FILTER (acct_balance > 9000 OR (acct_balance < 0 AND acct_balance >= -500)) AS n FROM c360) "
        "SELECT 'acct_balance' AS \"column\", 0.0::double AS low, 9000.0::double AS high, "
        "CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS severity, n AS violations FROM v",
    ),
    "imbalance_nulls": with_(
        C360,
        ", l AS (SELECT churned FROM c360 WHERE acct_balance >= 0), "
        "s AS (SELECT count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY churned) "
        "SELECT round(min(share), 6) AS minority_share, min(share) < 0.3::double AS imbalanced FROM s",
    ),
    "revenue_at_risk_nan": with_(
        C360 + _holes("total_sales") + (SCORED + insight_queries._RISK).removeprefix(C360).replace("c360", "holes"),
        "SELECT tier, customers, round(revenue, 1) AS revenue, round(revenue_at_risk, 1) AS revenue_at_risk, "
        "round(avg_churn_probability, 4) AS avg_churn_probability FROM per_tier",
    ),
    "geo_city_nan": with_(
        C360 + _holes("total_sales"),
        "SELECT customer_city AS city, customer_state AS country, count(*) AS customers, round(avg(churned), 2) AS churn_rate, "
        "round(sum(total_sales), 2) AS total_revenue, round(avg(total_sales), 2) AS avg_revenue FROM holes GROUP BY 1, 2",
    ),
    "sigmoid_nulls": with_(
        C360,
        "SELECT customer_id, round(1 / (1 + exp(-(nullif(website_visits, 0) / 10.0::double - 2))), 6) AS activity FROM c360",
    ),
    "what_if_nulls": with_(
        C360 + _holes("unit_price") + insight_queries._WHATIF.removeprefix(C360).replace("c360", "holes"),
        "SELECT customer_id, feature, round(max_impact, 2) AS max_impact, round(avg_impact, 2) AS avg_impact, "
        "round(sensitivity, 2) AS sensitivity FROM i",
    ),
}
