"""Catalogue: profiles, correlations, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation, quality, stats
from ..operators.quality import RangeRule
from ..operators.quantiles import exact_quantiles
from ..session import materialize
from ..sources import reports
from . import tables
from .oracle_base import C360, RETAIL_TX, with_
from .shared import TIE_SHIFT, customers, rounded

PROFILED = ["acct_balance", "quantity", "total_sales", "website_visits", "days_since_last_purchase"]
CORRELATED = [
    "quantity", "unit_price", "discount_applied", "days_since_last_purchase", "total_transactions",
    "num_purchases", "website_visits", "membership_years", "acct_balance", "product_return_rate",
]
RULES = [
    RangeRule("acct_balance", low=0.0),
    RangeRule("total_sales", high=1500000.0, severity="warning"),
    RangeRule("num_purchases", low=18.0, high=120.0),
]
TAIL_PROBS = [0.05, 0.5, 0.95, 0.99]
SPLIT_DATE = "1998-01-01"


def _power_law(lines):
    """A heavy tail made of the prices: their sixth power."""
    x = F.col("l_extendedprice").cast("double") / F.lit(10000.0)
    return lines.select("l_returnflag", (x * x * x * x * x * x).alias("v"))


def _with_nulls(spark, d):
    """Customers where zero activity counts as unknown, so nulls come from the data."""
    base = tables.customers(spark, d)
    return base.select(
        "customer_id", "segment",
        F.nullif(F.col("website_visits"), F.lit(0)).alias("website_visits"),
        F.nullif(F.col("customer_support_calls"), F.lit(0)).alias("support_calls"),
        F.when(F.col("acct_balance") >= -900, F.col("acct_balance")).alias("acct_balance"),
    )


def _corr_base(spark, d):
    return tables.customers(spark, d).select(*CORRELATED, "total_sales", "churned")


def _stored(spark, d, *columns):
    return customers(spark, d, *columns)


def _drift(spark, d):
    """Sales before a date against sales since; the figures live in lines and orders, so only these are joined."""
    line, orders = tables.load(spark, d, "lineitem"), tables.load(spark, d, "orders")
    tx = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_quantity").cast("double").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_applied"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_sales"),
        F.col("o_orderdate").alias("transaction_date"),
    )
    cut = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return quality.drift_between(
        tx, ["quantity", "unit_price", "discount_applied", "total_sales"],
        baseline=F.col("transaction_date") < cut,
        current=F.col("transaction_date") >= cut,
    )


def _category_counts(spark, d):
    """Lines per product category, counted by product before the products are joined."""
    lines = tables.load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = tables.load(spark, d, "part")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy(F.col("p_type").alias("value")).agg(F.sum("n").alias("count"))


def _findings(spark, d):
    return quality.findings(
        _with_nulls(spark, d).withColumn("num_purchases", F.col("support_calls") * 2),
        expected={"customer_id": ["bigint"], "segment": ["bigint"], "age": ["int"], "website_visits": ["bigint"],
                  "support_calls": ["bigint"], "acct_balance": ["double"]},
        critical=["customer_id", "acct_balance"],
        rules=RULES,
    )


def _reports(spark, d):
    """One quality run per order month: the run passes while few orders are huge."""
    orders = tables.load(spark, d, "orders")
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file")).agg(
        F.max("o_orderdate").alias("timestamp"),
        (F.avg(F.when(F.col("o_totalprice") > 450000, 1.0).otherwise(0.0)) < 0.1).alias("passed"),
    )


QUERIES = {
    "null_profile": lambda spark, d: stats.null_profile(_with_nulls(spark, d)),
    "numeric_profile": lambda spark, d: rounded(stats.numeric_profile(_stored(spark, d, *PROFILED), PROFILED)),
    "numeric_info": lambda spark, d: rounded(
        stats.numeric_info(tables.customers(spark, d).select(*PROFILED), PROFILED)
    ),
    "feature_info": lambda spark, d: stats.level_info(
        tables.retail_tx(spark, d), ["product_category", "product_brand", "store_city", "customer_state"]
    ),
    "value_counts": lambda spark, d: rounded(
        stats.summed_shares(_category_counts(spark, d), "value"), 6
    ),
    "target_stats": lambda spark, d: rounded(
        stats.target_stats(tables.customers(spark, d).select("total_sales"), "total_sales")
    ),
    "describe": lambda spark, d: rounded(stats.describe(_stored(spark, d, *PROFILED), PROFILED)),
    "quantiles": lambda spark, d: rounded(
        exact_quantiles(
            tables.load(spark, d, "lineitem").select("l_extendedprice", "l_returnflag"), "l_extendedprice",
            [0.05, 0.25, 0.5, 0.75, 0.95], by=["l_returnflag"],
        )
    ),
    # brackets far above the bound at every scale, so that they are cut at equal counts
    "quantiles_tail": lambda spark, d: rounded(
        exact_quantiles(
            materialize(_power_law(tables.load(spark, d, "lineitem")), "tail"), "v", TAIL_PROBS, by=["l_returnflag"],
            accuracy=500, bound=500,
        )
    ),
    "duplicate_rows": lambda spark, d: stats.duplicate_rows(
        tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    ),
    "corr_long": lambda spark, d: rounded(
        correlation.correlation_pairs(_corr_base(spark, d), [*CORRELATED, "total_sales"]).drop("i", "j"), 6
    ),
    "corr_target_topk": lambda spark, d: rounded(
        correlation.strongest(_corr_base(spark, d), CORRELATED, "total_sales", 5), 6
    ),
    "corr_significance": lambda spark, d: rounded(
        correlation.t_statistics(_corr_base(spark, d), CORRELATED, "churned"), 6, t=4
    ),
    "corr_stars": lambda spark, d: correlation.significance(_corr_base(spark, d), CORRELATED, "churned").select(
        "feature", "stars"
    ),
    "corr_labels": lambda spark, d: correlation.target_correlations(
        _corr_base(spark, d), CORRELATED, "total_sales"
    ).select("feature", correlation.strength("correlation").alias("strength"),
             correlation.direction("correlation").alias("direction")),
    "corr_cross_target": lambda spark, d: rounded(
        correlation.cross_target(_corr_base(spark, d), CORRELATED, "total_sales", "churned", 5), 6
    ),
    "corr_named": lambda spark, d: rounded(
        correlation.named(
            correlation.target_correlations(_corr_base(spark, d), CORRELATED, "churned"),
            ["quantity", "unit_price", "age", "website_visits"],
        ), 6,
    ),
    "corr_top_bottom": lambda spark, d: rounded(
        correlation.top_and_bottom(
            materialize(correlation.target_correlations(_corr_base(spark, d), CORRELATED, "churned"), "corr"), 3
        ), 6,
    ),
    "segment_box": lambda spark, d: rounded(
        stats.box_summary(_stored(spark, d, "segment", "total_sales"), "segment", "total_sales")
    ),
    "segment_means": lambda spark, d: rounded(
        stats.group_means(
            tables.customers(spark, d).withColumn("total_sales", F.col("total_sales") + 1e-7),
            "segment", ["total_sales", "num_purchases"],
        ), 2,
    ),
    "dq_nulls": lambda spark, d: quality.null_findings(_with_nulls(spark, d), ["customer_id", "acct_balance"]),
    "dq_missing_total": lambda spark, d: stats.total_missing(_with_nulls(spark, d)),
    "dq_ranges": lambda spark, d: quality.range_findings(
        tables.customers(spark, d).select("acct_balance", "total_sales", "num_purchases"), RULES
    ),
    "dq_drift": lambda spark, d: rounded(_drift(spark, d), 6, baseline=4, current=4),
    "dq_imbalance": lambda spark, d: rounded(
        quality.imbalance(customers(spark, d, "churned"), "churned"), 6
    ),
    "dq_findings": _findings,
    "dq_summary": lambda spark, d: quality.summary(_findings(spark, d)),
    "report_counts": lambda spark, d: reports.report_counts(_reports(spark, d)),
    "report_retention": lambda spark, d: reports.keep_newest(_reports(spark, d), "timestamp", 5),
}

_NULLS = C360 + """, n AS (
  SELECT customer_id, segment, nullif(website_visits, 0) AS website_visits,
         nullif(customer_support_calls, 0) AS support_calls,
         CASE WHEN acct_balance >= -900 THEN acct_balance END AS acct_balance FROM c360
)"""
_NULL_COLUMNS = ["customer_id", "segment", "website_visits", "support_calls", "acct_balance"]
_NULL_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, "
    f"floor(count(*) FILTER ({c} IS NULL) * 10000.0::double / count(*) + 0.5::double) / 100 AS null_pct FROM n"
    for c in _NULL_COLUMNS
)
_NULL_SEVERITY = (
    "CASE WHEN \"column\" IN ('customer_id', 'acct_balance') THEN CASE WHEN null_count > 0 THEN 'error' ELSE 'ok' END "
    "WHEN null_pct > 5 THEN 'warning' ELSE 'ok' END"
)
_CORR = ", r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, total_sales) AS s, corr({c}, churned) AS k, "
    f"count(*) FILTER ({c} IS NOT NULL) AS n FROM c360"
    for c in CORRELATED
) + ")"
_PAIRS = [*CORRELATED, "total_sales"]
_FINDINGS = _NULLS + f""", m AS (SELECT *, support_calls * 2 AS num_purchases FROM n), f AS (
  SELECT 'nulls' AS "check", "column" AS subject, {_NULL_SEVERITY} AS severity, null_pct AS detail
  FROM ({_NULL_ROWS} UNION ALL
        SELECT 'num_purchases', count(*) FILTER (num_purchases IS NULL),
               floor(count(*) FILTER (num_purchases IS NULL) * 10000.0::double / count(*) + 0.5::double) / 100 FROM m)
  UNION ALL SELECT 'ranges', 'acct_balance', CASE WHEN count(*) FILTER (acct_balance < 0) > 0 THEN 'error' ELSE 'ok' END,
         (count(*) FILTER (acct_balance < 0))::double FROM m
  UNION ALL SELECT 'ranges', 'num_purchases',
         CASE WHEN count(*) FILTER (num_purchases < 18 OR num_purchases > 120) > 0 THEN 'error' ELSE 'ok' END,
         (count(*) FILTER (num_purchases < 18 OR num_purchases > 120))::double FROM m
  UNION ALL SELECT 'schema', 'age', 'error', NULL
  UNION ALL SELECT 'schema', 'segment', 'warning', NULL
  UNION ALL SELECT 'schema', 'num_purchases', 'warning', NULL
)"""
_MONTHS = """WITH m AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS file, max(o_orderdate) AS "timestamp",
         avg(CASE WHEN o_totalprice > 450000 THEN 1.0::double ELSE 0.0::double END) < 0.1::double AS passed
  FROM orders GROUP BY 1
)"""


def _moments(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'mean' AS metric, avg({c}) AS v FROM retail_tx WHERE {where} "
        f"UNION ALL SELECT '{c}', 'std', stddev_samp({c}) FROM retail_tx WHERE {where}"
        for c in ("quantity", "unit_price", "discount_applied", "total_sales")
    )


ORACLES = {
    "null_profile": with_(_NULLS, _NULL_ROWS),
    "numeric_profile": with_(
        C360,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"round(min({c})::double, 4) AS min, round(max({c})::double, 4) AS max, "
            f"round(quantile_cont({c}::double, 0.5), 4) AS median FROM c360"
            for c in PROFILED
        ),
    ),
    "numeric_info": with_(
        C360,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(min({c})::double, 4) AS min, round(max({c})::double, 4) AS max, "
            f"round(avg({c}), 4) AS mean FROM c360"
            for c in PROFILED
        ),
    ),
    "feature_info": with_(
        RETAIL_TX,
        ", l AS ("
        + " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS feature, {c} AS level FROM retail_tx"
            for c in ("product_category", "product_brand", "store_city", "customer_state")
        )
        + "), p AS (SELECT *, (row_number() OVER (PARTITION BY feature ORDER BY level))::integer AS position FROM l) "
        "SELECT * FROM p WHERE position <= 50",
    ),
    "value_counts": with_(
        RETAIL_TX,
        "SELECT product_category AS value, count(*) AS \"count\", "
        "round(count(*) / (SELECT count(*) FROM retail_tx), 6) AS share FROM retail_tx GROUP BY 1",
    ),
    "target_stats": with_(
        C360,
        "SELECT round(avg(total_sales), 4) AS mean, round(stddev_samp(total_sales), 4) AS std_sample, "
        "round(stddev_pop(total_sales), 4) AS std_population FROM c360",
    ),
    "describe": with_(
        C360,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, round(min({c})::double, 4) AS min, "
            + ", ".join(f"round(quantile_cont({c}::double, {q}), 4) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
            + f", round(max({c})::double, 4) AS max FROM c360"
            for c in PROFILED
        ),
    ),
    "quantiles": " UNION ALL ".join(
        f"SELECT l_returnflag, round({q}::double, 4) AS prob, round(quantile_cont(l_extendedprice, {q}), 4) AS quantile "
        "FROM lineitem GROUP BY 1"
        for q in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
    "quantiles_tail": " UNION ALL ".join(
        f"SELECT l_returnflag, round({q}::double, 4) AS prob, round({TIE_SHIFT} + quantile_cont(x * x * x * x * x * x, {q}), 4) AS quantile "
        "FROM (SELECT l_returnflag, l_extendedprice / 10000.0::double AS x FROM lineitem) GROUP BY 1"
        for q in TAIL_PROBS
    ),
    "duplicate_rows": "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem",
    "corr_long": with_(
        C360,
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS correlation FROM c360"
            for i, a in enumerate(_PAIRS)
            for b in _PAIRS[i + 1:]
        ),
    ),
    "corr_target_topk": with_(
        C360 + _CORR, "SELECT feature, round(s, 6) AS correlation FROM r ORDER BY abs(s) DESC, feature LIMIT 5"
    ),
    "corr_significance": with_(
        C360 + _CORR,
        "SELECT feature, round(k, 6) AS correlation, n, round(k * sqrt((n - 2) / (1 - k * k)), 4) AS t FROM r",
    ),
    # critical values of t from the normal ones (Cornish-Fisher; exact to 1e-6 from a hundred degrees of freedom on)
    "corr_stars": with_(
        C360 + _CORR,
        ", q AS (SELECT feature, n - 2 AS v, abs(k * sqrt((n - 2) / (1 - k * k))) AS t FROM r) "
        "SELECT feature, CASE " + " ".join(
            f"WHEN t > {z}::double + ({z}::double ^ 3 + {z}) / (4 * v) + (5 * {z}::double ^ 5 + 16 * {z}::double ^ 3 + 3 * {z}) / (96 * v * v) THEN '{s}'"
            for z, s in ((3.290526731491896, "***"), (2.5758293035489004, "**"), (1.959963984540054, "*"))
        ) + " ELSE '' END AS stars FROM q",
    ),
    "corr_labels": with_(
        C360 + _CORR,
        "SELECT feature, CASE WHEN abs(s) > 0.7::double THEN 'very strong' WHEN abs(s) > 0.5::double THEN 'strong' "
        "WHEN abs(s) > 0.3::double THEN 'moderate' ELSE 'weak' END AS strength, "
        "CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r",
    ),
    "corr_cross_target": with_(
        C360 + _CORR,
        "SELECT feature, round(abs(s), 6) AS abs_total_sales, round(abs(k), 6) AS abs_churned, "
        "round((abs(s) + abs(k)) / 2, 6) AS mean_abs FROM r ORDER BY (abs(s) + abs(k)) / 2 DESC, feature LIMIT 5",
    ),
    "corr_named": with_(
        C360 + _CORR,
        "SELECT w.feature, round(k, 6) AS correlation "
        "FROM (VALUES ('quantity'), ('unit_price'), ('age'), ('website_visits')) w(feature) "
        "LEFT JOIN r ON r.feature = w.feature",
    ),
    "corr_top_bottom": with_(
        C360 + _CORR,
        "SELECT * FROM (SELECT 'top' AS kind, feature, round(k, 6) AS correlation FROM r ORDER BY k DESC, feature LIMIT 3) "
        "UNION ALL SELECT * FROM (SELECT 'bottom', feature, round(k, 6) FROM r ORDER BY k, feature LIMIT 3)",
    ),
    "segment_box": with_(
        C360,
        "SELECT segment, round(min(total_sales), 4) AS min, round(quantile_cont(total_sales, 0.25), 4) AS q25, "
        "round(quantile_cont(total_sales, 0.5), 4) AS median, round(quantile_cont(total_sales, 0.75), 4) AS q75, "
        "round(max(total_sales), 4) AS max FROM c360 GROUP BY 1",
    ),
    "segment_means": with_(
        C360,
        "SELECT segment, round(avg(total_sales), 2) AS mean_total_sales, "
        "round(avg(num_purchases), 2) AS mean_num_purchases FROM c360 GROUP BY 1",
    ),
    "dq_nulls": with_(_NULLS, f"SELECT *, {_NULL_SEVERITY} AS severity FROM ({_NULL_ROWS})"),
    "dq_missing_total": with_(
        _NULLS,
        f"SELECT sum(null_count)::bigint AS total_nulls, count(*) FILTER (null_count > 0) AS columns_with_nulls "
        f"FROM ({_NULL_ROWS})",
    ),
    "dq_ranges": with_(
        C360,
        ", v AS (SELECT count(*) FILTER (acct_balance < 0) AS a, count(*) FILTER (total_sales > 1500000) AS b, "
        "count(*) FILTER (num_purchases < 18 OR num_purchases > 120) AS c FROM c360) "
        "SELECT 'acct_balance' AS \"column\", 0.0::double AS low, NULL::double AS high, "
        "CASE WHEN a > 0 THEN 'error' ELSE 'ok' END AS severity, a AS violations FROM v "
        "UNION ALL SELECT 'total_sales', NULL, 1500000.0, CASE WHEN b > 0 THEN 'warning' ELSE 'ok' END, b FROM v "
        "UNION ALL SELECT 'num_purchases', 18.0, 120.0, CASE WHEN c > 0 THEN 'error' ELSE 'ok' END, c FROM v",
    ),
    "dq_drift": with_(
        RETAIL_TX,
        f", b AS ({_moments(f'transaction_date < DATE {SPLIT_DATE!r}')}), "
        f"c AS ({_moments(f'transaction_date >= DATE {SPLIT_DATE!r}')}) "
        'SELECT b."column", b.metric, round(b.v, 4) AS baseline, round(c.v, 4) AS "current", '
        "round(abs((c.v - b.v) / b.v), 6) AS change, abs((c.v - b.v) / b.v) > 0.2::double AS drifted "
        'FROM b JOIN c ON b."column" = c."column" AND b.metric = c.metric WHERE b.v <> 0',
    ),
    "dq_imbalance": with_(
        C360,
        ", s AS (SELECT count(*) / (SELECT count(*) FROM c360) AS share FROM c360 GROUP BY churned) "
        "SELECT round(min(share), 6) AS minority_share, min(share) < 0.3::double AS imbalanced FROM s",
    ),
    "dq_findings": with_(_FINDINGS, "SELECT * FROM f"),
    "dq_summary": with_(
        _FINDINGS,
        "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, "
        "count(*) AS checks, count(*) FILTER (severity = 'error') = 0 AS passed FROM f",
    ),
    "report_counts": _MONTHS
    + ' SELECT count(*) AS reports, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, '
    'arg_max(file, "timestamp") AS latest, arg_max(passed, "timestamp") AS latest_passed FROM m',
    "report_retention": _MONTHS + ' SELECT * FROM m ORDER BY "timestamp" DESC LIMIT 5',
}
