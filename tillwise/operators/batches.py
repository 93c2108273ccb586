"""Mini-batches of fixed size in a random order that follows from row keys.

The order of an epoch is that of a hash of the key with the epoch's seed, so batches are the same on every
cluster. Rows are range-partitioned by it and numbered per partition; a table of one row per partition
says how many rows come before. No task sorts more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Stages
from .sampling import hash_order


def batch_numbers(df: DataFrame, key: str, size: int, stages: Stages, seed: int = 42) -> DataFrame:
    """``df`` with ``pos``, its place in the epoch's order, and ``batch``, of ``size`` rows but for the last.

    Rows of one key are ordered by a hash of the whole row; equal rows may stand for each other.
    """
    spark = df.sparkSession
    order = ["_order", "_row"]
    marked = df.withColumns({"_order": hash_order(key, seed), "_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    ranged = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    stored = stages.keep(ranged.drop(*order).withColumn("_place", F.monotonically_increasing_id()), "batches")
    part = F.shiftrightunsigned("_place", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = stages.keep(counts.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "batch-starts")
    pos = F.col("_before") + F.col("_place") - F.col("_first")
    placed = stored.withColumn("_part", part).join(starts, "_part").withColumn("pos", pos)
    return placed.drop("_part", "_place", "_first", "_before").withColumn("batch", F.expr(f"pos div {size}"))
