"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ranges import BOUND, bounded_ranges


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    ties: Sequence[str] = (),
    bound: int = BOUND,
) -> DataFrame:
    """Add ``cum_<c>`` for every column in ``sums``, cumulated over ``order``.

    Rows that share an ``order`` value are taken in the order of ``ties`` (numbers, dates
    or times, ascending); for totals per distinct value, aggregate first. The input is read
    once for every count and cut, so hand in a stored table.
    Value ranges are cut until each holds at most ``bound`` rows, their totals are cumulated
    and joined back as offsets, and rows are then cumulated range by range. The number of
    ranges follows the row count, so a sort never holds more than ``bound`` rows.
    """
    by = list(by)
    # a constant key stands for "no groups"; ranges keep the group key so that
    # equal ranges of different groups never mix
    keyed = df.withColumn("_g", F.struct(*by) if by else F.lit(0))
    keys = [(order, descending), *[(t, False) for t in ties]]
    placed, totals = bounded_ranges(keyed, ["_g"], keys, sums, bound)
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_g", "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    row_key = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy("_g", "_range").orderBy(row_key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, ["_g", "_range"])
        .withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(within) for c in sums})
        .drop("_g", "_range", *[f"_o_{c}" for c in sums])
    )
