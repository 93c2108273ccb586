"""Splits and samples that depend on row keys only.

``randomSplit`` and ``sample`` draw per partition, so their outcome changes with
the cluster. A keyed hash gives the same rows everywhere and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import as_col
from ..session import materialize

BUCKETS = 10_000


def _digest(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(as_col(key).cast("string"), F.lit(f"|{seed}")))


def hash_bucket(key: str | Column, seed: int = 42) -> Column:
    """A number from 0 to 9999, uniform over keys."""
    return F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("long") % BUCKETS


def hash_order(key: str | Column, seed: int = 42) -> Column:
    """60-bit position of a key in a random order."""
    return F.conv(F.substring(_digest(key, seed), 1, 15), 16, 10).cast("long")


def in_share(key: str | Column, share: float, seed: int = 42) -> Column:
    return hash_bucket(key, seed) < round(share * BUCKETS)


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash; narrow, and stable when the table grows."""
    test = in_share(key, test_share, seed)
    return df.where(~test), df.where(test)


def _selected(df: DataFrame, need: DataFrame, orders: list[Column]) -> DataFrame:
    """``df`` with ``_first``: whether a row is among the ``_need`` first of its group ``_g``.

    Only one number a group is wanted, the order of its last row to take. It is
    found 16 bits at a time: counts of the leading bits, combined before the
    shuffle, name the range that holds it, and the next count looks only there.
    No row is sorted or sent anywhere. Rows that share this order, when not all
    of them are taken, are told apart by the next of ``orders``; rows equal in
    all of them are equal in every column, and any of them will do.
    """
    if not orders:
        placed = df.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.lit(0)))).join(need, "_g")
        return placed.withColumn("_first", F.col("_n") <= F.col("_need")).drop("_n", "_need")
    marked = df.withColumn("_order", orders[0])
    state, known = need, 60
    while known:
        bits = min(16, known)
        here = marked.select("_g", "_order").join(state, "_g")
        if known < 60:
            here = here.where(F.shiftright("_order", known) == F.col("_lead")).drop("_lead", "_n")
        known -= bits
        counts = here.groupBy("_g", "_need", F.shiftright("_order", known).alias("_lead")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_lead"))  # 65536 rows a group at most
        found = counts.withColumn("_upto", upto).where("_upto >= _need and _upto - _n < _need")
        state = materialize(found.selectExpr("_g", "_need - _upto + _n AS _need", "_lead", "_n"), "rank-range")
    joined = marked.join(state, "_g", "left")
    split = F.coalesce((F.col("_order") == F.col("_lead")) & (F.col("_n") > F.col("_need")), F.lit(False))
    extra = ["_order", "_lead", "_n", "_need"]
    clear = joined.where(~split).withColumn("_first", F.coalesce(F.col("_order") <= F.col("_lead"), F.lit(False))).drop(*extra)
    ties = state.where("_n > _need")
    if ties.isEmpty():
        return clear
    return clear.unionByName(_selected(joined.where(split).drop(*extra), ties.select("_g", "_need"), orders[1:]))


def _orders(df: DataFrame, key: str, seed: int) -> list[Column]:
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [hash_order(key, seed), F.shiftrightunsigned(rest, 4)]


def exact_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Flag exactly floor(share x n) rows as ``is_test``, per ``by`` group when given; by hash of ``key``.

    Rows of one key that stands more than once are told apart by a hash of the
    whole row. Hand in a stored table.
    """
    rows = df.withColumn("_g", F.struct(*by) if by else F.lit(0))
    need = rows.groupBy("_g").agg(F.floor(F.count("*") * test_share).cast("long").alias("_need")).where("_need > 0")
    picked = _selected(rows, materialize(need, "wanted"), _orders(df, key, seed))
    return picked.withColumnRenamed("_first", "is_test").drop("_g")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer), the same on every run and by one plan for every n."""
    rows = df.withColumn("_g", F.lit(0))
    need = rows.groupBy("_g").agg(F.least(F.count("*"), F.lit(n)).alias("_need")).where("_need > 0")
    return _selected(rows, materialize(need, "wanted"), _orders(df, key, seed)).where("_first").drop("_first", "_g")
