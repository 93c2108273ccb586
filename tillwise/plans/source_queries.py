"""Catalogue: sources and sinks, each as a round trip of a given table through the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..learning import evaluate
from ..operators import evaluation, projection
from ..session import shared_folder
from ..sources import readers, reports, writers
from . import evaluation_queries, insight_queries, tables
from .oracle_base import RETAIL_TX, with_
from .shared import rounded, scored_customers


def _folder(spark, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _landed(spark, d):
    """A table written as CSV, landed as Parquet with its schema, and read."""
    source = tables.load(spark, d, "supplier")
    csv, parquet = _folder(spark, "csv"), _folder(spark, "landed")
    source.write.option("header", True).csv(csv)
    return writers.land_csv(spark, csv, parquet, source.schema)


def _inferred(spark, d):
    """The same without a schema: types come from the text."""
    csv = _folder(spark, "csv")
    tables.load(spark, d, "nation").write.option("header", True).csv(csv)
    names = readers.read_csv(spark, csv)
    return names.select("n_nationkey", "n_name", "n_regionkey")


def _fallback(spark, d):
    return readers.first_readable(spark, [_folder(spark, "absent"), f"{d}/region.parquet"])


def _partitioned(spark, d):
    """Orders written by priority; one partition read back alone, all of them counted."""
    path = _folder(spark, "orders")
    writers.write_table(tables.load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "o_orderpriority")
    stored = spark.read.parquet(path)
    return stored.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("dearest"))


def _segments(spark, d):
    """The segment export as CSV, read back."""
    path = _folder(spark, "segments")
    writers.export_segments(scored_customers(spark, d), path)
    return rounded(readers.read_csv(spark, path, _SEGMENT_ROWS).drop("export_date"), 2)


_SEGMENT_ROWS = (
    "segment string, `count` long, avg_total_sales double, avg_churn_prob double, total_revenue double, "
    "description string, export_date timestamp, total_customers long, all_revenue double"
)


def _reported(spark, d):
    """Regression results through an evaluation report: written as JSON, the newest one read."""
    path = _folder(spark, "reports")
    regression = evaluate.regression_results(evaluation_queries.sales_predictions(spark, d))
    classification = evaluate.classification_results(evaluation_queries.class_predictions(spark, d))
    reports.append_report(reports.evaluation_report(classification, regression), path)
    return rounded(reports.latest_metrics(spark, path)[1], 4)


def _logged(spark, d):
    """Metrics of two runs in the metric log."""
    path = _folder(spark, "metrics")
    results = evaluation.regression_metrics(evaluation_queries.sales_predictions(spark, d))
    for run in ("first", "second"):
        reports.log_metrics(results, ["rmse", "r2"], path, run)
    return rounded(spark.read.parquet(path).select("run", "model", "metric", "value"), 4)


def _projected(spark, d):
    """Sums of the numeric columns that are left without identifiers."""
    tx = projection.numeric_only(projection.drop_ids(tables.retail_tx(spark, d)))
    tx = projection.rename(tx, {"discount_applied": "discount"})
    names = projection.numeric_columns(tx)
    long = tx.select([F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "column", "value")
    return long.groupBy("column").agg(F.round(F.sum("value"), 0).alias("total"))


QUERIES = {
    "csv_landed": _landed,
    "csv_inferred": _inferred,
    "fallback_source": _fallback,
    "partitioned_table": _partitioned,
    "segments_file": _segments,
    "report_round_trip": _reported,
    "metric_log": _logged,
    "projected_sums": _projected,
}

_METRICS = insight_queries.with_(evaluation_queries._SALES, "SELECT * FROM rm").rsplit("SELECT * FROM rm", 1)[0]

ORACLES = {
    "csv_landed": "SELECT * FROM supplier",
    "csv_inferred": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "fallback_source": "SELECT * FROM region",
    "partitioned_table": "SELECT o_orderpriority, count(*) AS orders, round(max(o_totalprice), 2) AS dearest FROM orders GROUP BY 1",
    "segments_file": insight_queries.ORACLES["segments_export"],
    "report_round_trip": _METRICS + "SELECT model, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, "
    "round(mape, 4) AS mape, 'OK' AS status FROM rm",
    "metric_log": _METRICS + "SELECT run, model, metric, round(value, 4) AS value FROM (SELECT 'first' AS run UNION ALL SELECT 'second'), "
    "(SELECT model, 'rmse' AS metric, rmse AS value FROM rm UNION ALL SELECT model, 'r2', r2 FROM rm)",
    "projected_sums": with_(
        RETAIL_TX,
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"column\", round(sum({c})::double, 0) AS total FROM retail_tx"
            for c, name in (("quantity", "quantity"), ("unit_price", "unit_price"), ("discount_applied", "discount"),
                            ("total_sales", "total_sales"), ("returned", "returned"), ("product_size", "product_size"),
                            ("order_id", "order_id"))
        ),
    ),
}
