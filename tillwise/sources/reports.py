"""Report tables: validation and evaluation reports as JSON, the metric log, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import metric_name

VALIDATION_SCHEMA = """
file string, timestamp timestamp, passed boolean, errors long, warnings long, checks long,
issues array<struct<check string, subject string, severity string, detail double>>
"""
# Layout of a model-evaluation report.
EVALUATION_SCHEMA = """
timestamp string,
classification struct<
  results: array<struct<model: string, accuracy: double, precision: double, recall: double, f1_score: double,
    confusion_matrix: struct<TN: long, FP: long, FN: long, TP: long>, status: string>>,
  models_evaluated: long, models_failed: long, best_model: string, best_f1: double>,
regression struct<
  results: array<struct<model: string, rmse: double, mae: double, r2: double, mape: double, status: string>>,
  models_evaluated: long, models_failed: long, best_model: string, best_r2: double>,
total_models_evaluated long
"""


def append_report(report: DataFrame, path: str) -> None:
    """One more report file next to the earlier ones."""
    report.coalesce(1).write.mode("append").json(path)


def read_reports(spark: SparkSession, path: str, schema: str = VALIDATION_SCHEMA, newest: int = 10) -> DataFrame:
    """The newest reports; files that are not valid JSON are skipped."""
    read = (
        spark.read.schema(schema + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("source"))
    )
    # a file cut short still yields its leading fields, so the marker decides; every
    # report has a time, and Spark wants a data column read next to the marker
    usable = read.where(F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull()).drop("_corrupt_record")
    return usable.orderBy(F.col("modified").desc(), F.col("source").desc()).limit(newest)


def report_counts(reports: DataFrame, time: str = "timestamp", name: str = "file") -> DataFrame:
    """Passed and failed runs, and the latest one."""
    return reports.agg(
        F.count("*").alias("reports"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.max_by(name, time).alias("latest"),
        F.max_by("passed", time).alias("latest_passed"),
    )


def keep_newest(reports: DataFrame, time: str, n: int = 5, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The n newest rows (of each group); the rank filter runs per task before any shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(time).desc(), *ties)
    return reports.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def newest_object(objects: DataFrame, path: str = "path", time: str = "modified") -> DataFrame:
    return objects.agg(F.max_by(path, time).alias(path), F.max(time).alias(time))


def evaluation_report(classification: DataFrame, regression: DataFrame) -> DataFrame:
    """Nested one-row report of two result tables (one row per model).

    The best model is the one that holds the best metric.
    """

    def part(results: DataFrame, metric: str, best: str) -> DataFrame:
        ok = F.col("status") == "OK"
        return results.agg(
            F.struct(
                F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"),
                F.count_if(ok).alias("models_evaluated"),
                F.count_if(~ok).alias("models_failed"),
                F.max_by("model", F.when(ok, F.col(metric))).alias("best_model"),
                F.max(F.when(ok, F.col(metric))).alias(best),
            ).alias("part")
        )

    clf = part(classification, "f1_score", "best_f1").scalar()
    reg = part(regression, "r2", "best_r2").scalar()
    one = classification.sparkSession.range(1)
    return one.select(
        F.current_timestamp().cast("string").alias("timestamp"), clf.alias("classification"), reg.alias("regression")
    ).withColumn(
        "total_models_evaluated",
        F.col("classification.models_evaluated") + F.col("regression.models_evaluated"),
    )


def latest_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classification, regression) result rows of the newest evaluation report."""
    latest = read_reports(spark, path, EVALUATION_SCHEMA, newest=1)
    return (
        latest.select(F.inline("classification.results")),
        latest.select(F.inline("regression.results")),
    )


def metric_rows(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One named scalar per model and metric."""
    long = results.select("model", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["model"], list(metrics), "metric", "value"
    )
    return long.select(metric_name("model", "metric").alias("name"), "model", "metric", "value")


def log_metrics(results: DataFrame, metrics: Sequence[str], path: str, run: str) -> None:
    """Append to the metric log, one folder per run."""
    metric_rows(results, metrics).withColumn("run", F.lit(run)).coalesce(1).write.mode("append").partitionBy(
        "run"
    ).parquet(path)
