"""Exact interpolated quantiles in bounded passes.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here
pass one takes a quantile sketch (bounded memory, map-side merge) and brackets
each wanted rank. Pass two counts rows per value inside the brackets and per gap
between them; repeated values collapse in the partial aggregation. A bracket
holds about n x 10 / accuracy values. Where that could be above the bound, the
brackets' values are written and cut at equal counts by sketches of their own,
again and again until every range is within the bound (``operators/ranges.py``),
whatever the skew of values or groups. The counts of ranges and gaps tell which
range holds the rank, and only the values of that range are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import as_col, clean
from ..functions.scalars import one_row
from ..session import materialize
from .ranges import BOUND, bounded_ranges

ACCURACY = 20_000


def with_group_stats(rows: DataFrame, *stats: Column, grouped: bool) -> DataFrame:
    """Put per-group aggregates (key ``_g``) on every row without moving the rows.

    Without groups the figures travel as a scalar subquery. With groups they are
    written first, so Spark knows their true size: a small table is broadcast by
    the size threshold, a large one falls back to a skew-split sort-merge join.
    """
    if not grouped:
        return _with_stats(rows, rows.agg(*stats), grouped)
    return _with_stats(rows, materialize(rows.groupBy("_g").agg(*stats), "groups"), grouped)


def _with_stats(rows: DataFrame, stats: DataFrame, grouped: bool) -> DataFrame:
    if grouped:
        return rows.join(stats, "_g")
    names = [n for n in stats.columns if n != "_g"]
    rows = rows.withColumn("_stats", one_row(stats.select(*names)))
    return rows.select("*", *[F.col("_stats")[n].alias(n) for n in names]).drop("_stats")


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    bound: int = BOUND,
) -> DataFrame:
    """Rows ``(*by, prob, quantile)``; null and NaN values are left out.

    Equals linear interpolation between the two neighbouring order statistics.
    No sort holds more than ``bound`` values. The input is read twice, so hand in a stored table rather than a long plan.
    """
    by = list(by)
    probs = sorted({float(p) for p in probs})
    slack = 4.0 / accuracy
    edges: list[float] = []
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    rows = df.select(*by, clean(value).alias("_v")).where(F.col("_v").isNotNull())

    # the key is a struct, which is never null itself; a constant means "no groups"
    rows = rows.select((F.struct(*by) if by else F.lit(0)).alias("_g"), "_v")
    stats = materialize(
        rows.groupBy("_g").agg(
            F.count("*").alias("_n"), F.percentile_approx("_v", F.lit(edges), F.lit(accuracy)).alias("_edges")
        ),
        "groups",
    )
    placed = _with_stats(rows, stats, bool(by)).select("_g", "_n", "_v", F.expr(_bracket_sql(len(probs), accuracy)).alias("_b"))
    is_gap = (F.col("_n") > accuracy) & (F.col("_b") % 2 == 0)
    counted = (
        placed.select("_g", "_n", "_b", F.when(~is_gap, F.col("_v")).alias("_v"))
        .groupBy("_g", "_n", "_b", "_v")
        .agg(F.count("*").alias("_c"))
    )
    largest = stats.agg(F.max("_n")).first()[0] or 0
    if max(min(largest, accuracy), largest * 10 // accuracy) > bound:
        counted, ranges = bounded_ranges(materialize(counted, "brackets"), ["_g", "_n", "_b"], [("_v", False)], ["_c"], bound)
        ranges = ranges.select("_g", "_n", "_b", "_range", F.col("_t__c").alias("_size"))
    else:
        counted = counted.withColumn("_range", F.lit(""))
        ranges = counted.groupBy("_g", "_n", "_b", "_range").agg(F.sum("_c").alias("_size"))
    # gaps are a number fixed by the probabilities, ranges at most the brackets' values over the bound
    before = Window.partitionBy("_g").orderBy("_b", "_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        ranges.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("prob", F.explode(F.lit(probs)))
    )
    position = F.col("prob") * (F.col("_n") - 1)

    def inside(start: Column, end: Column) -> tuple[Column, Column]:
        """Whether the lower and the upper neighbour of the position lie in [start, end)."""
        return tuple((r(position) >= start) & (r(position) < end) for r in (F.floor, F.ceil))

    low_hit, high_hit = inside(F.col("_before"), F.col("_before") + F.col("_size"))
    hits = sizes.where(low_hit | high_hit).select("_g", "_b", "_range", "prob", "_before")
    order = Window.partitionBy("_g", "_b", "_range", "prob").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(hits, ["_g", "_b", "_range"]).withColumn("_end", F.col("_before") + F.sum("_c").over(order))
    low_row, high_row = inside(F.col("_end") - F.col("_c"), F.col("_end"))
    exact = F.when(
        is_gap, F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")
    ).otherwise(F.col("_v"))
    found = (
        ranked.where(low_row | high_row)
        .groupBy("_g", "_n", "prob")
        .agg(F.max(F.when(low_row, exact)).alias("_lo"), F.max(F.when(high_row, exact)).alias("_hi"))
    )
    weight = position - F.floor(position)
    result = (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * weight).alias("quantile")
    return found.select(*[F.col("_g")[c].alias(c) for c in by], "prob", result)


def _bracket_sql(brackets: int, accuracy: int) -> str:
    """Number of the bracket or gap a value lies in, growing with the value.

    Bracket i spans edges 2i and 2i+1 and is number 2i + 1; the gap after it is 2i + 2.
    Up to ``accuracy`` rows a bracket may miss a neighbouring rank, and the group is no
    larger than a bracket of a large one, so all of it forms one bracket.
    """
    branches = [
        f"WHEN _v >= _edges[{2 * i}] THEN if(_v <= _edges[{2 * i + 1}], {2 * i + 1}, {2 * i + 2})"
        for i in reversed(range(brackets))
    ]
    return f"CASE WHEN _n <= {accuracy} THEN 1 {' '.join(branches)} ELSE 0 END"


def quantile_value(df: DataFrame, value: str | Column, prob: float) -> Column:
    """One exact quantile of a whole table as a scalar subquery."""
    return exact_quantiles(df, as_col(value), [prob]).select("quantile").scalar()
