"""Table sources: CSV, Parquet, fallback paths, counts and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Column types of the raw retail table.
_LONG = ["customer_id", "transaction_id", "product_id", "promotion_id"]
_TIME = [
    "transaction_date", "last_purchase_date", "product_manufacture_date",
    "product_expiry_date", "promotion_start_date", "promotion_end_date",
]
FRESHNESS_DAYS = 30


def raw_schema(columns: Sequence[str], text: Sequence[str]) -> T.StructType:
    """Declared schema of a raw table: ids long, dates timestamp, listed text columns, rest double."""

    def kind(name: str) -> T.DataType:
        if name in _LONG:
            return T.LongType()
        if name in _TIME:
            return T.TimestampNTZType()
        return T.StringType() if name in text else T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, at the cost of one more scan."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; a missing path raises when the plan is built."""
    return spark.read.parquet(path)


def first_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of several locations that can be read."""
    problems = []
    for path in paths:
        try:
            return read_table(spark, path)
        except AnalysisException as problem:
            problems.append(f"{path}: {problem.getCondition()}")
    raise FileNotFoundError("no readable source: " + "; ".join(problems))


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table; counts read no column data."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def freshness(df: DataFrame, today: Column | None = None, limit_days: int = FRESHNESS_DAYS) -> DataFrame:
    """Age in days of the newest file behind a file-based table, and whether it is too old."""
    newest = df.agg(F.max("_metadata.file_modification_time").alias("last_modified"))
    age = F.datediff(F.current_date() if today is None else today, F.col("last_modified"))
    return newest.select("last_modified", age.alias("age_days"), (age > limit_days).alias("stale"))
