"""Catalogue: base tables and business insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights, whatif
from ..sources import readers, writers
from . import tables
from .oracle_base import AS_OF, C360, CLV, RETAIL_TX, SCORED, with_
from .shared import clv_customers, customers, rounded, scored_customers

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ALL_TABLES = [*TABLES, *(t for t in tables.SOURCES if t not in TABLES)]
# The campaigns of the demonstration query.
CAMPAIGNS = [
    (1000000.0, "high_risk"), (2000000.0, "medium_risk"), (5000000.0, "all"),
    (100000000000.0, "high_risk"), (0.0, "all"),
]


def _campaigns(spark):
    return spark.createDataFrame(CAMPAIGNS, "campaign_budget double, target_segment string")


def _clv_trends(period):
    return lambda spark, d: rounded(
        insights.clv_trends(clv_customers(spark, d), period),
        total_revenue=1, clv_growth_rate=6, expected_clv_growth_rate=6,
    )


def _geo_base(spark, d):
    return tables.customers(spark, d).select("customer_city", "customer_state", "churned", "total_sales")


QUERIES = {
    "retail_tx": lambda spark, d: rounded(tables.retail_tx(spark, d)),
    "customer_360": lambda spark, d: rounded(tables.customer_360(spark, d)),
    "rfm": lambda spark, d: rounded(tables.rfm(spark, d)),
    "table_counts": lambda spark, d: readers.table_counts(
        {t: tables.load(spark, d, t) for t in ALL_TABLES}
    ),
    "revenue_at_risk": lambda spark, d: rounded(insights.revenue_at_risk(scored_customers(spark, d)), 1, avg_churn_probability=4),
    "campaign_roi": lambda spark, d: rounded(
        insights.campaign_roi(scored_customers(spark, d), _campaigns(spark)), 2
    ),
    "customer_segments": lambda spark, d: rounded(insights.customer_segments(scored_customers(spark, d)), 2),
    "segment_totals": lambda spark, d: rounded(
        insights.segment_totals(tables.customers(spark, d).select("total_sales")), 2
    ),
    "segments_export": lambda spark, d: rounded(
        writers.segment_export_rows(scored_customers(spark, d)), 2
    ).drop("export_date"),
    "clv_estimate": lambda spark, d: rounded(
        insights.clv_estimate(
            scored_customers(spark, d, "membership_years", "total_transactions", "avg_purchase_value")
        ).select(
            "customer_id", "recency_factor", "adjusted_lifespan", "estimated_annual_frequency",
            "clv_estimate", "expected_clv",
        )
    ),
    "clv_trends_monthly": _clv_trends("monthly"),
    "clv_trends_quarterly": _clv_trends("quarterly"),
    "clv_trends_yearly": _clv_trends("yearly"),
    "clv_insights": lambda spark, d: rounded(insights.clv_insights(clv_customers(spark, d)), 2),
    "geo_city": lambda spark, d: rounded(insights.geo_cities(_geo_base(spark, d)), total_revenue=1),
    "geo_state": lambda spark, d: rounded(insights.geo_states(insights.geo_cities(_geo_base(spark, d)))),
    "geo_kpis": lambda spark, d: rounded(insights.geo_kpis(insights.geo_cities(_geo_base(spark, d)))),
    "geo_rollup": lambda spark, d: rounded(insights.geo_rollup(_geo_base(spark, d)), total_revenue=1).drop("level"),
    "geo_top_cities": lambda spark, d: rounded(
        insights.top_n(insights.geo_cities(_geo_base(spark, d)), "customers", 10, "city"), total_revenue=1
    ),
    "geo_best_worst_states": lambda spark, d: rounded(
        insights.best_worst(insights.geo_states(insights.geo_cities(_geo_base(spark, d))), "churn_rate", "country", 3)
    ),
    "risk_label": lambda spark, d: scored_customers(spark, d)
    .groupBy(insights.risk_label("churn_probability").alias("risk"))
    .agg(F.count("*").alias("customers")),
    "revenue_range": lambda spark, d: rounded(
        tables.customers(spark, d).select(
            "customer_id",
            insights.revenue_range("total_sales")[0].alias("lower_bound"),
            insights.revenue_range("total_sales")[1].alias("upper_bound"),
        )
    ),
    "what_if_formula": lambda spark, d: rounded(
        whatif.impacts(
            customers(spark, d, "customer_id", "quantity", "unit_price", "discount_applied"),
            ["quantity", "unit_price", "discount_applied"],
            lambda c: c["quantity"] * c["unit_price"] * (1 - c["discount_applied"]),
            key="customer_id",
        ),
        2,
    ),
    "what_if_ranking": lambda spark, d: whatif.most_and_least_sensitive(
        whatif.impacts(
            customers(spark, d, "customer_id", "quantity", "unit_price", "discount_applied"),
            ["quantity", "unit_price", "discount_applied"],
            lambda c: c["quantity"] * c["unit_price"] * (1 - c["discount_applied"]),
            key="customer_id",
        ),
        key="customer_id",
    ),
}

_TIERS = """
SELECT CASE WHEN p > 0.7::double THEN 'high_risk' WHEN p > 0.4::double THEN 'medium_risk' ELSE 'low_risk' END AS tier,
       total_sales, p FROM scored
"""
_RISK = f"""
, tiered AS ({_TIERS}), per_tier AS (
  SELECT d.tier, count(p) AS customers, coalesce(sum(total_sales), 0) AS revenue,
         coalesce(sum(total_sales * p), 0) AS revenue_at_risk, coalesce(avg(p), 0) AS avg_churn_probability
  FROM (VALUES ('high_risk'), ('medium_risk'), ('low_risk')) d(tier) LEFT JOIN tiered t ON t.tier = d.tier
  GROUP BY 1
  UNION ALL
  SELECT 'total', count(*), sum(total_sales), sum(total_sales * p), avg(p) FROM tiered
)"""
_SEGMENTED = """
, cut AS (SELECT quantile_cont(total_sales, 0.75) AS q FROM scored), seg AS (
  SELECT CASE WHEN total_sales >= q AND p <= 0.3::double THEN 'Champions'
              WHEN total_sales >= q AND p <= 0.7::double THEN 'Loyal Customers'
              WHEN total_sales >= q THEN 'At Risk'
              WHEN p <= 0.3::double THEN 'New Customers'
              WHEN p > 0.7::double THEN 'Need Attention' ELSE 'Unassigned' END AS segment, total_sales, p
  FROM scored, cut
), seg_rows AS (
  SELECT d.segment, count(p) AS "count", round(coalesce(avg(total_sales), 0), 2) AS avg_total_sales,
         round(coalesce(avg(p), 0), 2) AS avg_churn_prob,
         round(coalesce(sum(total_sales), 0), 2) AS total_revenue, d.description
  FROM (VALUES ('Champions', 'High value customers with low churn risk'),
               ('Loyal Customers', 'High value customers with medium churn risk'),
               ('At Risk', 'High value customers with high churn risk'),
               ('New Customers', 'Lower value customers with low churn risk'),
               ('Need Attention', 'Lower value customers with high churn risk'),
               ('Unassigned', 'Lower value customers with medium churn risk')) d(segment, description)
  LEFT JOIN seg ON seg.segment = d.segment GROUP BY d.segment, d.description
)"""
_GEO = """
, city AS (
  SELECT customer_city AS city, customer_state AS country, count(*) AS customers, avg(churned) AS churn_rate,
         sum(total_sales) AS total_revenue, avg(total_sales) AS avg_revenue
  FROM c360 GROUP BY 1, 2
), state AS (
  SELECT country, sum(customers)::bigint AS customers, avg(churn_rate) AS churn_rate,
         avg(total_revenue) AS avg_city_revenue,
         sum(churn_rate * customers) / sum(customers) AS weighted_churn_rate,
         sum(total_revenue) / sum(customers) AS revenue_per_customer
  FROM city GROUP BY 1
)"""
_CITY_COLS = """city, country, customers, round(churn_rate, 4) AS churn_rate,
 round(total_revenue, 1) AS total_revenue, round(avg_revenue, 4) AS avg_revenue"""
_STATE_COLS = """country, customers, round(churn_rate, 4) AS churn_rate,
 round(avg_city_revenue, 4) AS avg_city_revenue, round(weighted_churn_rate, 4) AS weighted_churn_rate,
 round(revenue_per_customer, 4) AS revenue_per_customer"""


def _trend_sql(key: str) -> str:
    return with_(
        CLV,
        f"""
, k AS (SELECT *, {key} AS period FROM clv WHERE transaction_date IS NOT NULL),
cuts AS (SELECT period, quantile_cont(clv_estimate, 0.75) AS q FROM k GROUP BY 1),
t AS (
  SELECT k.period, avg(clv_estimate) AS a, avg(expected_clv) AS e, avg(p) AS pr, count(*) AS n,
         sum(total_sales) AS rev, count(*) FILTER (clv_estimate > q) AS hv, count(*) FILTER (p > 0.7::double) AS ar
  FROM k JOIN cuts ON cuts.period = k.period GROUP BY 1
), l AS (SELECT *, lag(a) OVER (ORDER BY period) AS pa, lag(e) OVER (ORDER BY period) AS pe FROM t)
SELECT period, round(a, 4) AS avg_clv, round(e, 4) AS avg_expected_clv, round(pr, 4) AS avg_churn_probability,
       n AS customer_count, round(rev, 1) AS total_revenue, hv AS high_value_customers, ar AS at_risk_customers,
       round(CASE WHEN pa > 0 THEN (a - pa) / pa WHEN pa IS NOT NULL THEN 0.0::double END, 6) AS clv_growth_rate,
       round(CASE WHEN pe > 0 THEN (e - pe) / pe WHEN pe IS NOT NULL THEN 0.0::double END, 6)
         AS expected_clv_growth_rate
FROM l""",
    )


_WHATIF = C360 + """, w AS (
  SELECT customer_id, quantity, unit_price, discount_applied FROM c360
), s AS (
  SELECT stddev_samp(quantity) AS sq, min(quantity) AS lq, max(quantity) AS hq,
         stddev_samp(unit_price) AS su, min(unit_price) AS lu, max(unit_price) AS hu,
         stddev_samp(discount_applied) AS sd, min(discount_applied) AS ld, max(discount_applied) AS hd FROM w
), m AS (SELECT unnest([-2.0::double, -1.0::double, 1.0::double, 2.0::double]) AS m), v AS (
  SELECT customer_id, 'quantity' AS feature, quantity * unit_price * (1 - discount_applied) AS base,
         (CASE WHEN m < 0 THEN greatest(quantity + m * sq, lq) ELSE least(quantity + m * sq, hq) END)
           * unit_price * (1 - discount_applied) AS pred FROM w, s, m
  UNION ALL
  SELECT customer_id, 'unit_price', quantity * unit_price * (1 - discount_applied),
         quantity * (CASE WHEN m < 0 THEN greatest(unit_price + m * su, lu) ELSE least(unit_price + m * su, hu) END)
           * (1 - discount_applied) FROM w, s, m
  UNION ALL
  SELECT customer_id, 'discount_applied', quantity * unit_price * (1 - discount_applied),
         quantity * unit_price * (1 - (CASE WHEN m < 0 THEN greatest(discount_applied + m * sd, ld)
                                            ELSE least(discount_applied + m * sd, hd) END)) FROM w, s, m
), i AS (
  SELECT customer_id, feature, max(abs(pred - base)) AS max_impact, avg(abs(pred - base)) AS avg_impact,
         max(abs(pred - base)) - min(abs(pred - base)) AS sensitivity
  FROM v GROUP BY 1, 2
)"""

ORACLES = {
    "retail_tx": with_(
        RETAIL_TX,
        "SELECT * REPLACE (round(unit_price, 4) AS unit_price, round(total_sales, 4) AS total_sales, "
        "round(quantity, 4) AS quantity, round(discount_applied, 4) AS discount_applied) FROM retail_tx",
    ),
    "customer_360": with_(
        C360,
        "SELECT * REPLACE (round(acct_balance, 4) AS acct_balance, round(quantity, 4) AS quantity, "
        "round(gross_sales, 4) AS gross_sales, round(total_sales, 4) AS total_sales, "
        "round(unit_price, 4) AS unit_price, round(avg_purchase_value, 4) AS avg_purchase_value, "
        "round(discount_applied, 4) AS discount_applied, round(product_return_rate, 4) AS product_return_rate) "
        "FROM c360",
    ),
    "rfm": f"""
SELECT o_custkey AS customer_id, date_diff('day', max(o_orderdate), {AS_OF})::integer AS recency_days,
       count(DISTINCT o_orderkey) AS frequency,
       round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0) / count(DISTINCT o_orderkey), 4) AS monetary
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS \"rows\", "
        f"(SELECT count(*) FROM (DESCRIBE {t}))::bigint AS \"columns\""
        for t in ALL_TABLES
    ),
    "revenue_at_risk": with_(
        SCORED + _RISK,
        "SELECT tier, customers, round(revenue, 1) AS revenue, round(revenue_at_risk, 1) AS revenue_at_risk, "
        "round(avg_churn_probability, 4) AS avg_churn_probability FROM per_tier",
    ),
    "campaign_roi": with_(
        SCORED + _RISK,
        """, c AS (
  SELECT b AS campaign_budget, s AS target_segment,
         CASE WHEN s IN ('high_risk', 'medium_risk') THEN s ELSE 'total' END AS tier,
         CASE s WHEN 'high_risk' THEN 0.3::double WHEN 'medium_risk' THEN 0.5::double ELSE 0.2::double END AS rate
  FROM (VALUES """
        + ", ".join(f"({b!r}::double, '{s}')" for b, s in CAMPAIGNS)
        + """) v(b, s)
), j AS (
  SELECT campaign_budget, target_segment, revenue_at_risk AS potential, rate, revenue_at_risk * rate AS saved,
         CASE WHEN campaign_budget > 0
              THEN (revenue_at_risk * rate - campaign_budget) / nullif(campaign_budget, 0) * 100 ELSE 0 END AS roi
  FROM c JOIN per_tier USING (tier)
)
SELECT round(campaign_budget, 2) AS campaign_budget, target_segment,
       round(potential, 2) AS potential_revenue_at_risk, round(rate * 100, 2) AS expected_retention_improvement,
       round(saved, 2) AS revenue_saved, round(roi, 2) AS roi_percentage,
       round(CASE WHEN saved > 0 THEN campaign_budget / (saved / 12) END, 2) AS payback_period_months,
       CASE WHEN roi > 50 THEN 'Proceed' WHEN roi > 0 THEN 'Consider alternative strategies'
            ELSE 'Not recommended' END AS recommendation
FROM j""",
    ),
    "customer_segments": with_(SCORED + _SEGMENTED, "SELECT * FROM seg_rows"),
    "segments_export": with_(
        SCORED + _SEGMENTED,
        'SELECT segment, "count", avg_total_sales, avg_churn_prob, total_revenue, description, '
        "(SELECT count(*) FROM scored) AS total_customers, "
        "(SELECT round(sum(total_sales), 2) FROM scored) AS all_revenue FROM seg_rows WHERE segment <> 'Unassigned'",
    ),
    "segment_totals": with_(
        C360,
        "SELECT count(*) AS total_customers, round(sum(total_sales), 2) AS total_revenue, "
        "round(sum(total_sales) / count(*) * 3, 2) AS avg_customer_lifetime_value FROM c360",
    ),
    "clv_estimate": with_(
        CLV,
        "SELECT customer_id, round(recency_factor, 4) AS recency_factor, "
        "round(adjusted_lifespan, 4) AS adjusted_lifespan, "
        "round(estimated_annual_frequency, 4) AS estimated_annual_frequency, "
        "round(clv_estimate, 4) AS clv_estimate, round(expected_clv, 4) AS expected_clv FROM clv",
    ),
    "clv_trends_monthly": _trend_sql("strftime(transaction_date, '%Y-%m')"),
    "clv_trends_quarterly": _trend_sql("year(transaction_date) || 'Q' || quarter(transaction_date)"),
    "clv_trends_yearly": _trend_sql("year(transaction_date)::varchar"),
    "clv_insights": with_(
        CLV,
        """, cut AS (SELECT quantile_cont(clv_estimate, 0.75) AS q FROM clv)
SELECT round(avg(clv_estimate), 2) AS current_avg_clv, round(avg(expected_clv), 2) AS current_avg_expected_clv,
       round(avg(p), 2) AS current_avg_churn_probability, count(*) AS total_customers,
       round(sum(total_sales), 2) AS total_revenue,
       round(avg(clv_estimate) / (avg(total_sales) / count(*)), 2) AS clv_revenue_ratio,
       round(avg(clv_estimate) / avg(total_sales), 2) AS clv_to_mean_revenue,
       count(*) FILTER (clv_estimate > (SELECT q FROM cut)) AS high_value_segment_size,
       count(*) FILTER (p > 0.7::double) AS at_risk_segment_size, 'monthly' AS period,
       count(DISTINCT strftime(transaction_date, '%Y-%m')) AS trend_periods
FROM clv""",
    ),
    "geo_city": with_(C360 + _GEO, f"SELECT {_CITY_COLS} FROM city"),
    "geo_state": with_(C360 + _GEO, f"SELECT {_STATE_COLS} FROM state"),
    "geo_kpis": with_(
        C360 + _GEO,
        "SELECT sum(customers)::bigint AS total_customers, round(avg(churn_rate), 4) AS avg_churn_rate, "
        "round(avg(total_revenue), 4) AS avg_city_revenue, count(DISTINCT country) AS countries FROM city",
    ),
    "geo_rollup": with_(
        C360,
        "SELECT customer_state AS country, customer_city AS city, count(*) AS customers, "
        "round(avg(churned), 4) AS churn_rate, round(sum(total_sales), 1) AS total_revenue "
        "FROM c360 GROUP BY ROLLUP (customer_state, customer_city)",
    ),
    "geo_top_cities": with_(C360 + _GEO, f"SELECT {_CITY_COLS} FROM city ORDER BY customers DESC, city LIMIT 10"),
    "geo_best_worst_states": with_(
        C360 + _GEO,
        f"""SELECT 'best' AS kind, b.* FROM (SELECT {_STATE_COLS} FROM state s ORDER BY s.churn_rate, country LIMIT 3) b
UNION ALL
SELECT 'worst', w.* FROM (SELECT {_STATE_COLS} FROM state s ORDER BY s.churn_rate DESC, country LIMIT 3) w""",
    ),
    "risk_label": with_(
        SCORED,
        "SELECT CASE WHEN p < 0.3::double THEN 'Low Risk' WHEN p < 0.6::double THEN 'Medium Risk' "
        "ELSE 'High Risk' END AS risk, count(*) AS customers FROM scored GROUP BY 1",
    ),
    "revenue_range": with_(
        C360,
        "SELECT customer_id, round(total_sales * (1 - (1 - 0.8::double)), 4) AS lower_bound, "
        "round(total_sales * (1 + (1 - 0.8::double)), 4) AS upper_bound FROM c360",
    ),
    "what_if_formula": with_(
        _WHATIF,
        "SELECT customer_id, feature, round(max_impact, 2) AS max_impact, round(avg_impact, 2) AS avg_impact, "
        "round(sensitivity, 2) AS sensitivity FROM i",
    ),
    "what_if_ranking": with_(
        _WHATIF,
        "SELECT customer_id, arg_max(feature, max_impact) AS most_sensitive_feature, "
        "arg_min(feature, max_impact) AS least_sensitive_feature, 12::bigint AS total_variations_tested "
        "FROM i GROUP BY 1",
    ),
}
