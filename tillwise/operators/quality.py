"""Data-quality rules as tables of findings ``(check, subject, severity, detail)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import clean
from .stats import moments, null_profile, value_counts

# Limits of the rules and the columns every input needs.
NULL_WARNING_PCT = 5.0
DRIFT_LIMIT = 0.2
MINORITY_SHARE = 0.3
CRITICAL_COLUMNS = ["website_session_id", "created_at", "user_id"]
REQUIRED_COLUMNS = [
    "age", "gender", "income_bracket", "total_sales", "churned", "product_category",
    "payment_method", "loyalty_program", "membership_years",
]
EXPECTED_SCHEMAS = {
    "website_sessions": {
        "website_session_id": ["bigint"], "created_at": ["timestamp"], "user_id": ["bigint"],
        "is_repeat_session": ["bigint"], "utm_source": ["string"], "utm_campaign": ["string"],
        "utm_content": ["string"], "device_type": ["string"], "http_referer": ["string"],
    },
    "orders": {
        "order_id": ["bigint"], "created_at": ["timestamp"], "website_session_id": ["bigint"],
        "user_id": ["bigint"], "price_usd": ["double"],
    },
    "website_pageviews": {
        "website_pageview_id": ["bigint"], "created_at": ["timestamp"],
        "website_session_id": ["bigint"], "pageview_url": ["string"],
    },
    "training_data": {"total_sales": ["double"], "churned": ["bigint", "boolean", "int"]},
}


@dataclass(frozen=True)
class RangeRule:
    """``below``/``above`` a bound counts as a violation of the given severity."""

    column: str
    low: float | None = None
    high: float | None = None
    severity: str = "error"


# Accepted ranges.
RANGE_RULES = [
    RangeRule("price_usd", low=0.0),
    RangeRule("price_usd", high=10000.0, severity="warning"),
    RangeRule("total_sales", low=0.0),
    RangeRule("total_sales", high=100000.0, severity="warning"),
    RangeRule("age", low=18.0, high=120.0),
]


def null_findings(df: DataFrame, critical: Sequence[str] = CRITICAL_COLUMNS, max_pct: float = NULL_WARNING_PCT) -> DataFrame:
    """Any null in a critical column is an error; above the limit elsewhere is a warning."""
    is_critical = F.col("column").isin(list(critical))
    severity = (
        F.when(is_critical & (F.col("null_count") > 0), "error")
        .when(~is_critical & (F.col("null_pct") > max_pct), "warning")
        .otherwise("ok")
    )
    return null_profile(df).select("column", "null_count", "null_pct", severity.alias("severity"))


def range_findings(df: DataFrame, rules: Sequence[RangeRule] = RANGE_RULES) -> DataFrame:
    """Violations of every applicable rule, counted in one pass."""
    usable = [r for r in rules if r.column in df.columns]
    if not usable:
        return df.sparkSession.createDataFrame(
            [], "column string, low double, high double, severity string, violations long"
        )
    structs = []
    for r in usable:
        value = clean(r.column)
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value < r.low)
        if r.high is not None:
            broken = broken | (value > r.high)
        n = F.count_if(broken)
        structs.append(
            F.struct(
                F.lit(r.column).alias("column"),
                F.lit(r.low).cast("double").alias("low"),
                F.lit(r.high).cast("double").alias("high"),
                F.when(n > 0, r.severity).otherwise("ok").alias("severity"),
                n.alias("violations"),
            )
        )
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))


def schema_rows(df: DataFrame) -> DataFrame:
    """``(column, type)`` of a table, from its schema alone."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string"
    )


def schema_findings(df: DataFrame, expected: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Missing -> error, extra -> warning, type outside the accepted prefixes -> warning; without expectation the types are recorded."""
    actual = schema_rows(df)
    if not expected:
        return actual.select("column", F.lit("recorded").alias("issue"), F.lit("ok").alias("severity"), "type")
    wanted = df.sparkSession.createDataFrame(
        [(c, list(t)) for c, t in expected.items()], "column string, accepted array<string>"
    )
    missing = wanted.join(actual, "column", "left_anti").select(
        "column", F.lit("missing").alias("issue"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("type")
    )
    extra = actual.join(wanted, "column", "left_anti").select(
        "column", F.lit("extra").alias("issue"), F.lit("warning").alias("severity"), "type"
    )
    fits = F.exists("accepted", lambda a: F.col("type").startswith(a))
    wrong = actual.join(wanted, "column").where(~fits).select(
        "column", F.lit("type").alias("issue"), F.lit("warning").alias("severity"), "type"
    )
    return missing.unionByName(extra).unionByName(wrong)


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The table itself, or an error naming the absent columns."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def drift(current: DataFrame, baseline: DataFrame, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Relative change of mean and std per column of two profiles; a zero baseline is skipped."""

    def long(profile: DataFrame, out: str) -> DataFrame:
        return profile.select("column", "mean", "std").unpivot("column", ["mean", "std"], "metric", out)

    both = long(current, "current").join(long(baseline, "baseline"), ["column", "metric"])
    change = F.abs(F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline")))
    return (
        both.where(F.col("baseline") != 0)
        .withColumn("change", change)
        .withColumn("drifted", F.col("change") > limit)
        .select("column", "metric", "baseline", "current", "change", "drifted")
    )


def drift_between(
    df: DataFrame, columns: Sequence[str], baseline: Column, current: Column, limit: float = DRIFT_LIMIT
) -> DataFrame:
    """Drift between two row sets of one table, both profiled in a single pass."""
    sides = {"base": baseline, "now": current}
    marked = df.where(baseline | current).select(
        [F.when(test, F.col(c)).alias(f"{side}:{c}") for side, test in sides.items() for c in columns]
    )
    profile = moments(marked, marked.columns).withColumn("side", F.split_part("column", F.lit(":"), F.lit(1)))
    named = profile.withColumn("column", F.split_part("column", F.lit(":"), F.lit(2)))
    return drift(named.where("side = 'now'"), named.where("side = 'base'"), limit)


def drift_against(df: DataFrame, columns: Sequence[str], baseline_path: str, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Drift against a stored profile; the first run stores it and reports none."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        baseline = spark.read.parquet(baseline_path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        moments(df, columns).write.parquet(baseline_path)
        return drift(spark.read.parquet(baseline_path), spark.read.parquet(baseline_path), limit)
    return drift(moments(df, columns), baseline, limit)


def imbalance(df: DataFrame, label: str, minimum: float = MINORITY_SHARE) -> DataFrame:
    shares = value_counts(df, label)
    return shares.agg(F.min("share").alias("minority_share")).withColumn(
        "imbalanced", F.col("minority_share") < minimum
    )


def findings(
    df: DataFrame,
    expected: Mapping[str, Sequence[str]] | None = None,
    critical: Sequence[str] = CRITICAL_COLUMNS,
    rules: Sequence[RangeRule] = RANGE_RULES,
    baseline: DataFrame | None = None,
    drift_columns: Sequence[str] = (),
) -> DataFrame:
    """All checks as one list of findings."""
    parts = [
        null_findings(df, critical).select(
            F.lit("nulls").alias("check"), F.col("column").alias("subject"), "severity",
            F.col("null_pct").alias("detail"),
        ),
        range_findings(df, rules).select(
            F.lit("ranges").alias("check"), F.col("column").alias("subject"), "severity",
            F.col("violations").cast("double").alias("detail"),
        ),
    ]
    if expected:
        parts.append(
            schema_findings(df, expected).select(
                F.lit("schema").alias("check"), F.col("column").alias("subject"), "severity",
                F.lit(None).cast("double").alias("detail"),
            )
        )
    if baseline is not None:
        parts.append(
            drift(moments(df, drift_columns), baseline).select(
                F.lit("drift").alias("check"),
                F.concat_ws(".", "column", "metric").alias("subject"),
                F.when(F.col("drifted"), "warning").otherwise("ok").alias("severity"),
                F.col("change").alias("detail"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    """Passed flag, errors and warnings of a run."""
    return found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count("*").alias("checks"),
    ).withColumn("passed", F.col("errors") == 0)


def run_checks(df: DataFrame, **options) -> DataFrame:
    """:func:`summary` of all checks, computed now; a check that fails to run fails the report."""
    schema = "errors long, warnings long, checks long, passed boolean, problem string"
    try:
        row = summary(findings(df, **options)).first()
        values = (row["errors"], row["warnings"], row["checks"], row["passed"], None)
    except Exception as problem:  # an unusable table must give a failed report, not a crash
        values = (1, 0, 0, False, str(problem))
    return df.sparkSession.createDataFrame([values], schema)


def gate(report: DataFrame) -> None:
    """Raise when a one-row report says the run failed."""
    row = report.first()
    if not row["passed"]:
        raise ValueError(f"data quality failed: {row['errors']} errors, {row['warnings']} warnings")


def quality_report(spark: SparkSession, name: str, found: DataFrame) -> DataFrame:
    """One nested row per run: file, time, flag and the findings of the run."""
    bad = found.where(F.col("severity") != "ok").select("check", "subject", "severity", "detail")
    return summary(found).select(
        F.lit(name).alias("file"), F.current_timestamp().alias("timestamp"), "passed", "errors", "warnings", "checks",
        bad.agg(F.sort_array(F.collect_list(F.struct("check", "subject", "severity", "detail"))).alias("l"))
        .scalar().alias("issues"),
    )
