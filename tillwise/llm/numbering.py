"""Numbers from 0 within groups, without one task for a group.

A window over a group would sort the whole group in one task. Here rows are numbered per partition, and
a small table of (group, partition) counts says how many rows of the group stand in earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions


def offsets(counts: DataFrame, group: str, part: str) -> DataFrame:
    """``counts`` (``group, part, n``) with ``before``, the rows of the group in earlier parts, and its ``total``.

    A window sorts one row per partition of a group, never the group's rows.
    """
    order = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")),
            "total": F.sum("n").over(Window.partitionBy(group)),
        }
    )


def numbered(df: DataFrame, group: str, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``pos``, its place in ``group`` by ``order``, and ``total``, the group's rows.

    ``group`` must not be null. Rows are range-partitioned by group and order, so a large group spreads
    over many tasks; rows equal in all these columns are told apart by their place in the input, so a
    value that a third of the rows share spreads too. Hand in a stored table: it is read twice.
    """
    keys: list[Column] = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), *keys)
    placed = ranged.sortWithinPartitions(*keys).drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    stored = scratch.keep(placed, name).withColumn("_part", F.shiftrightunsigned("_place", 33))
    counts = stored.groupBy(group, "_part").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    runs = offsets(counts, group, "_part").drop("n")
    pos = F.col("before") + F.col("_place") - F.col("_first")
    return stored.join(runs, [group, "_part"]).withColumn("pos", pos).drop("_part", "_place", "_first", "before")
