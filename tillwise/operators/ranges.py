"""Ranges of bounded size over a global order, found by sketches instead of a sort of all rows.

Every row starts in one range per group. A range above the bound is cut at about equal row counts by
a quantile sketch of its own, and this is repeated until no range is above the bound: one pass up to
the bound, and two more passes for each factor of 256 beyond it. A value that a cut hits is a range by
itself, so a heavy value neither drags its neighbours along nor stops the cutting; if such a range is
still too large, the next key cuts it. Whatever the shape of the values, no later sort or window
over a range holds more than ``bound`` rows, unless they are equal in all keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

PIECES = 256
#: Rows a range may hold: what one task sorts in memory with ease.
BOUND = 1 << 17


def bounded_ranges(
    rows: DataFrame, group: Sequence[str], keys: Sequence[tuple[str, bool]], sums: Sequence[str] = (), bound: int = BOUND
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_range``, and the stored ranges: ``(*group, _range, _size, _t_<sum>)``.

    ``keys`` are pairs of a column (a number, date or time) and whether it descends; ``_range`` is a
    text that sorts as the rows do. Nulls are smallest. Hand in a stored table: it is read once for
    every count and every cut, and ``group`` must not hold nulls (wrap it in a struct).
    """
    first, falls = keys[0]
    # nulls stand apart from the start
    placed = rows.withColumn("_range", F.when(F.col(first).isNull() != F.lit(falls), "0").otherwise("1"))
    on = [*group, "_range"]
    while True:
        ranges = materialize(
            placed.groupBy(*on).agg(
                F.count("*").alias("_size"), *[F.sum(c).alias(f"_t_{c}") for c in sums], _varying(keys).alias("_key")
            ),
            "ranges",
        )
        large = ranges.where((F.col("_size") > bound) & F.col("_key").isNotNull()).select(*on, "_key")
        if large.isEmpty():
            return placed, ranges.drop("_key")
        probs = F.lit([i / PIECES for i in range(1, PIECES)])
        sketches = [
            F.percentile_approx(F.when(F.col("_key") == i, F.col(k)), probs, F.lit(10 * PIECES)).alias(f"_cuts{i}")
            for i, (k, _) in enumerate(keys)
        ]
        cuts = materialize(placed.join(large, on).groupBy(*on, "_key").agg(*sketches), "range-cuts")
        piece = F.coalesce(*[F.when(F.col("_key") == i, _piece(k, i, down)) for i, (k, down) in enumerate(keys)])
        text = F.coalesce(F.lpad(F.hex(piece), 3, "0"), F.lit(""))
        placed = (
            placed.join(cuts, on, "left")
            .withColumn("_range", F.concat("_range", text))
            .drop("_key", *[f"_cuts{i}" for i in range(len(keys))])
        )


def _varying(keys: Sequence[tuple[str, bool]]) -> Column:
    """Place of the first key with two values in the range; all keys before it are constant there."""
    several = [
        (F.coalesce(F.min(k) != F.max(k), F.lit(False))) | ((F.count(k) > 0) & (F.count(k) < F.count("*"))) for k, _ in keys
    ]
    return F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(several)])


def _piece(key: str, i: int, falls: bool) -> Column:
    """Number of the piece a row lies in: nulls, then by turns the rows between two cuts and those equal to a cut."""
    steps = ", ".join(str(2**b) for b in reversed(range(PIECES.bit_length() - 1)))
    below = F.expr(
        f"aggregate(array({steps}), 0, (pos, step) -> pos + if(coalesce(get(_cuts{i}, pos + step - 1) < `{key}`, false), step, 0))"
    )
    on_cut = F.coalesce(F.get(f"_cuts{i}", below) == F.col(key), F.lit(False)).cast("int")
    piece = F.when(F.col(key).isNull(), 0).otherwise(1 + 2 * below + on_cut)
    return F.lit(2 * PIECES - 1) - piece if falls else piece
