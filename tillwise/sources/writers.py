"""Table sinks: landing, feature table, segment export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import one_row
from ..operators.insights import customer_segments, segment_totals
from .readers import read_csv


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def land_csv(spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV to Parquet; returns the landed table."""
    write_table(read_csv(spark, csv_path, schema), parquet_path)
    return spark.read.parquet(parquet_path)


def segment_export_rows(scored: DataFrame) -> DataFrame:
    """The five segments with the export time and the totals on every row."""
    totals = one_row(segment_totals(scored))
    return (
        customer_segments(scored, show_unassigned=False)
        .withColumn("export_date", F.current_timestamp())
        .withColumn("_totals", totals)
        .withColumn("total_customers", F.col("_totals")["total_customers"])
        .withColumn("all_revenue", F.col("_totals")["total_revenue"])
        .drop("_totals")
    )


def export_segments(scored: DataFrame, path: str, format: str = "csv") -> None:
    """Write the segment table as CSV or JSON; other formats are refused."""
    kind = format.lower()
    if kind not in ("csv", "json"):
        raise ValueError("unsupported format: use 'csv' or 'json'")
    writer = segment_export_rows(scored).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
