"""Business queries over a customer table.

Every query reads the customer table once and returns a table whose size does
not grow with it (tiers, segments, periods, places), apart from the row-level
estimates. Global figures reach the rows as scalar subqueries. NaN counts as a missing value throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import as_col, cleaned, nonzero
from ..functions.scalars import one_row
from ..functions.text import period_key
from ..session import materialize
from .quantiles import exact_quantiles, quantile_value

# Risk tiers, retention rates, segment names and descriptions.
TIERS = ["high_risk", "medium_risk", "low_risk"]
RETENTION = {"high_risk": 0.3, "medium_risk": 0.5}
RETENTION_OTHERWISE = 0.2
SEGMENTS = [
    ("Champions", "High value customers with low churn risk"),
    ("Loyal Customers", "High value customers with medium churn risk"),
    ("At Risk", "High value customers with high churn risk"),
    ("New Customers", "Lower value customers with low churn risk"),
    ("Need Attention", "Lower value customers with high churn risk"),
]
UNASSIGNED = ("Unassigned", "Lower value customers with medium churn risk")


def rule_scored(
    df: DataFrame, sales: str = "total_sales", days: str | None = "days_since_last_purchase"
) -> DataFrame:
    """Add ``churn_probability`` from the two-rule score.

    Starts at 0.2; +0.3 for sales below the mean, +0.3 for more days than the
    mean (than 100 where the table has no such column); capped at 0.95.
    """
    df = cleaned(df)
    known_days = days is not None and days in df.columns
    means = [F.avg(sales).alias("sales")]
    if known_days:
        means.append(F.avg(days).alias("days"))
    mean = one_row(df.agg(*means))
    scored = df.withColumn("_mean", mean)
    low_sales = F.col(sales) < F.col("_mean")["sales"]
    if known_days:
        stale = F.col(days) > F.col("_mean")["days"]
    else:
        stale = F.lit(False)
    # Base score and the two steps.
    score = 0.2 + F.when(low_sales, 0.3).otherwise(0.0) + F.when(stale, 0.3).otherwise(0.0)
    return scored.withColumn("churn_probability", F.least(F.lit(0.95), score)).drop("_mean")


def risk_tier(p: str | Column, medium: float = 0.4, high: float = 0.7) -> Column:
    p = as_col(p)
    return F.when(p > high, "high_risk").when(p > medium, "medium_risk").otherwise("low_risk")


def risk_label(p: str | Column, medium: float = 0.3, high: float = 0.6) -> Column:
    p = as_col(p)
    return F.when(p < medium, "Low Risk").when(p < high, "Medium Risk").otherwise("High Risk")


def revenue_range(prediction: str | Column, confidence: str | Column | None = None) -> tuple[Column, Column]:
    """Bounds p(1 -+ (1 - confidence)); confidence is 0.8 where unknown."""
    p = as_col(prediction)
    conf = F.lit(0.8) if confidence is None else F.coalesce(as_col(confidence), F.lit(0.8))
    return p * (1 - (1 - conf)), p * (1 + (1 - conf))


def _fixed_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal dimension of a handful of rows; safe to broadcast by construction."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def revenue_at_risk(df: DataFrame) -> DataFrame:
    """Per tier and in total: customers, revenue, revenue x p, mean p; empty tiers show 0."""
    df = cleaned(df)
    p, sales = F.col("churn_probability"), F.col("total_sales")
    measured = (
        df.withColumn("tier", risk_tier(p))
        .groupBy("tier")
        .agg(
            F.count("*").alias("customers"),
            F.sum(sales).alias("revenue"),
            F.sum(sales * p).alias("revenue_at_risk"),
            F.sum(p).alias("p_sum"),
        )
    )
    tiers = _fixed_rows(df.sparkSession, [(t,) for t in TIERS], "tier string")
    full = measured.join(tiers, "tier", "right")
    # three tier rows at most: the total is one more level of a rollup over them
    return (
        full.rollup("tier")
        .agg(
            F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"),
            F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("revenue_at_risk"),
            F.sum("p_sum").alias("p_sum"),
        )
        .select(
            F.coalesce("tier", F.lit("total")).alias("tier"),
            "customers", "revenue", "revenue_at_risk",
            F.coalesce(F.try_divide("p_sum", "customers"), F.lit(0.0)).alias("avg_churn_probability"),
        )
    )


def campaign_roi(df: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Return of campaigns ``(campaign_budget, target_segment)`` on a scored customer table."""
    risk = revenue_at_risk(df).select("tier", F.col("revenue_at_risk").alias("potential_revenue_at_risk"))
    known = F.col("target_segment").isin(*RETENTION)
    rate = F.when(F.col("target_segment") == "high_risk", RETENTION["high_risk"]).when(
        F.col("target_segment") == "medium_risk", RETENTION["medium_risk"]
    ).otherwise(RETENTION_OTHERWISE)
    budget = F.col("campaign_budget").cast("double")
    saved = F.col("revenue_saved")
    roi = F.when(budget > 0, F.try_divide(saved - budget, budget) * 100).otherwise(0.0)
    return (
        campaigns.withColumn("tier", F.when(known, F.col("target_segment")).otherwise("total"))
        .join(F.broadcast(risk), "tier")  # four rows by construction
        .withColumn("_rate", rate)
        .withColumn("revenue_saved", F.col("potential_revenue_at_risk") * F.col("_rate"))
        .withColumn("roi_percentage", roi)
        .select(
            budget.alias("campaign_budget"),
            "target_segment",
            "potential_revenue_at_risk",
            (F.col("_rate") * 100).alias("expected_retention_improvement"),
            "revenue_saved",
            "roi_percentage",
            F.when(saved > 0, F.try_divide(budget, saved / 12)).alias("payback_period_months"),
            F.when(F.col("roi_percentage") > 50, "Proceed")
            .when(F.col("roi_percentage") > 0, "Consider alternative strategies")
            .otherwise("Not recommended")
            .alias("recommendation"),
        )
    )


def segment_of(p: str | Column, high_value: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """Segment name from value class and risk band; low value at medium risk has none."""
    p = as_col(p)
    return (
        F.when(high_value & (p <= low), "Champions")
        .when(high_value & (p <= high), "Loyal Customers")
        .when(high_value & (p > high), "At Risk")
        .when(p <= low, "New Customers")
        .when(p > high, "Need Attention")
        .otherwise(UNASSIGNED[0])
    )


def with_segment(df: DataFrame) -> DataFrame:
    """Add ``segment_name``; high value means total sales at or above the 75th percentile."""
    df = cleaned(df)
    cut = quantile_value(df, "total_sales", 0.75)
    high = F.col("total_sales") >= F.col("_cut")
    return df.withColumn("_cut", cut).withColumn("segment_name", segment_of("churn_probability", high)).drop("_cut")


def customer_segments(df: DataFrame, show_unassigned: bool = True) -> DataFrame:
    """Count, means and revenue of each segment; empty segments show 0."""
    df = cleaned(df)
    measured = (
        with_segment(df)
        .groupBy(F.col("segment_name").alias("segment"))
        .agg(
            F.count("*").alias("count"),
            F.avg("total_sales").alias("avg_total_sales"),
            F.avg("churn_probability").alias("avg_churn_prob"),
            F.sum("total_sales").alias("total_revenue"),
        )
    )
    names = SEGMENTS + ([UNASSIGNED] if show_unassigned else [])
    fixed = _fixed_rows(df.sparkSession, names, "segment string, description string")
    return measured.join(fixed, "segment", "right").select(
        "segment",
        F.coalesce("count", F.lit(0)).alias("count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_total_sales", "avg_churn_prob", "total_revenue")],
        "description",
    )


def segment_totals(df: DataFrame) -> DataFrame:
    """All customers, all revenue, and average lifetime value = revenue per customer x 3."""
    df = cleaned(df)
    n, revenue = F.count("*"), F.coalesce(F.sum("total_sales"), F.lit(0.0))
    return df.agg(n.alias("total_customers"), revenue.alias("total_revenue")).withColumn(
        "avg_customer_lifetime_value",
        F.coalesce(F.try_divide("total_revenue", "total_customers") * 3, F.lit(0.0)),
    )


def clv_estimate(df: DataFrame) -> DataFrame:
    """Add lifespan, recency, frequency and (expected) lifetime-value columns."""
    df = cleaned(df)
    longest = df.agg(F.max("days_since_last_purchase").alias("d")).scalar()
    lifespan = F.col("membership_years") + 1
    recency = F.lit(1.0) - F.try_divide(F.col("days_since_last_purchase").cast("double"), F.col("_longest"))
    return (
        df.withColumn("_longest", longest)
        .withColumn("recency_factor", recency)
        .withColumn("adjusted_lifespan", lifespan * (1 + F.col("recency_factor") * 0.3))
        .withColumn("estimated_annual_frequency", F.col("total_transactions") / nonzero("membership_years"))
        .withColumn(
            "clv_estimate",
            F.col("avg_purchase_value") * F.col("estimated_annual_frequency") * F.col("adjusted_lifespan"),
        )
        .withColumn("expected_clv", F.col("clv_estimate") * (1 - F.col("churn_probability")))
        .drop("_longest")
    )


def growth(current: str, order: str) -> Column:
    """Change against the previous period; null for the first, 0 when the previous is not positive."""
    before = F.lag(current).over(Window.orderBy(order))
    return F.when(before > 0, (F.col(current) - before) / before).when(before.isNotNull(), F.lit(0.0))


def clv_trends(df: DataFrame, period: str = "monthly", date: str = "transaction_date") -> DataFrame:
    """Lifetime value per calendar period with growth rates.

    ``df`` carries the columns of :func:`clv_estimate`. The value cut of each
    period is its own 75th percentile. Growth runs over one row per period.
    """
    df = cleaned(df)
    keyed = df.withColumn("period", period_key(date, period)).where(F.col("period").isNotNull())
    # written so that its true size (one row per period) decides the join strategy
    cuts = materialize(
        exact_quantiles(keyed, "clv_estimate", [0.75], by=["period"]).select(
            "period", F.col("quantile").alias("_cut")
        ),
        "period-cuts",
    )
    trend = (
        keyed.join(cuts, "period", "left")
        .groupBy("period")
        .agg(
            F.avg("clv_estimate").alias("avg_clv"),
            F.avg("expected_clv").alias("avg_expected_clv"),
            F.avg("churn_probability").alias("avg_churn_probability"),
            F.count("*").alias("customer_count"),
            F.sum("total_sales").alias("total_revenue"),
            F.count_if(F.col("clv_estimate") > F.col("_cut")).alias("high_value_customers"),
            F.count_if(F.col("churn_probability") > 0.7).alias("at_risk_customers"),
        )
    )
    return trend.withColumns(
        {
            "clv_growth_rate": growth("avg_clv", "period"),
            "expected_clv_growth_rate": growth("avg_expected_clv", "period"),
        }
    )


def clv_insights(df: DataFrame, period: str = "monthly", date: str = "transaction_date") -> DataFrame:
    """Overall lifetime-value figures in one row.

    ``clv_revenue_ratio`` keeps the published formula, which divides the mean
    revenue by the row count once more; ``clv_to_mean_revenue`` is the plain ratio.
    """
    df = cleaned(df)
    cut = quantile_value(df, "clv_estimate", 0.75)
    figures = df.withColumn("_cut", cut).agg(
        F.avg("clv_estimate").alias("current_avg_clv"),
        F.avg("expected_clv").alias("current_avg_expected_clv"),
        F.avg("churn_probability").alias("current_avg_churn_probability"),
        F.count("*").alias("total_customers"),
        F.sum("total_sales").alias("total_revenue"),
        F.avg("total_sales").alias("_mean"),
        F.count_if(F.col("clv_estimate") > F.col("_cut")).alias("high_value_segment_size"),
        F.count_if(F.col("churn_probability") > 0.7).alias("at_risk_segment_size"),
        F.countDistinct(period_key(date, period)).alias("trend_periods"),
    )
    return figures.select(
        "current_avg_clv", "current_avg_expected_clv", "current_avg_churn_probability",
        "total_customers", "total_revenue",
        F.coalesce(
            F.try_divide("current_avg_clv", F.try_divide("_mean", "total_customers")), F.lit(0.0)
        ).alias("clv_revenue_ratio"),
        F.coalesce(F.try_divide("current_avg_clv", "_mean"), F.lit(0.0)).alias("clv_to_mean_revenue"),
        "high_value_segment_size", "at_risk_segment_size",
        F.lit(period).alias("period"),
        "trend_periods",
    )


def geo_cities(df: DataFrame) -> DataFrame:
    """Customers, churn rate, total and mean revenue per city and state."""
    df = cleaned(df)
    return (
        df.groupBy(F.col("customer_city").alias("city"), F.col("customer_state").alias("country"))
        .agg(
            F.count("*").alias("customers"),
            F.avg("churned").alias("churn_rate"),
            F.sum("total_sales").alias("total_revenue"),
            F.avg("total_sales").alias("avg_revenue"),
        )
    )


def geo_states(cities: DataFrame) -> DataFrame:
    """State roll-up of a city table: unweighted means as published, weighted ones beside them."""
    n = F.sum("customers")
    return cities.groupBy("country").agg(
        n.alias("customers"),
        F.avg("churn_rate").alias("churn_rate"),
        F.avg("total_revenue").alias("avg_city_revenue"),
        F.try_divide(F.sum(F.col("churn_rate") * F.col("customers")), n).alias("weighted_churn_rate"),
        F.try_divide(F.sum("total_revenue"), n).alias("revenue_per_customer"),
    )


def geo_kpis(cities: DataFrame) -> DataFrame:
    return cities.agg(
        F.sum("customers").alias("total_customers"),
        F.avg("churn_rate").alias("avg_churn_rate"),
        F.avg("total_revenue").alias("avg_city_revenue"),
        F.countDistinct("country").alias("countries"),
    )


def geo_rollup(df: DataFrame) -> DataFrame:
    """City, state and grand-total levels in one pass."""
    df = cleaned(df)
    return (
        df.rollup("customer_state", "customer_city")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("customers"),
            F.avg("churned").alias("churn_rate"),
            F.sum("total_sales").alias("total_revenue"),
        )
        .withColumnsRenamed({"customer_state": "country", "customer_city": "city"})
    )


def top_n(df: DataFrame, metric: str | Column, n: int, *ties: str, descending: bool = True) -> DataFrame:
    """Largest (or smallest) n rows with a deterministic tie-break."""
    key = as_col(metric)
    return df.orderBy(key.desc() if descending else key.asc(), *ties).limit(n)


def best_worst(df: DataFrame, metric: str, name: str, n: int = 3) -> DataFrame:
    """The n rows with the lowest (``best``) and highest (``worst``) metric."""
    kind = lambda k, rows: rows.select(F.lit(k).alias("kind"), "*")
    best = kind("best", top_n(df, metric, n, name, descending=False))
    return best.unionByName(kind("worst", top_n(df, metric, n, name)))
