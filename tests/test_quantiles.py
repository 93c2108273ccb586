"""Exact quantiles, running totals and exact splits against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tillwise.operators.cumulative import running_totals
from tillwise.operators.quantiles import exact_quantiles, quantile_value
from tillwise.operators.ranges import bounded_ranges
from tillwise.operators.sampling import exact_split, sample_n
from tillwise.operators import sampling
from tillwise.session import materialize

PROBS = [0.0, 0.05, 0.25, 0.333, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of all rows, one group most of them."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100003)) / 97.0).alias("v"),
        F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("g"),
    )
    return materialize(rows, "test")


@pytest.mark.parametrize("accuracy", [100, 1000, 20000])
def test_quantiles_with_brackets(skewed, accuracy):
    pdf = skewed.toPandas()
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(skewed, "v", PROBS, ["g"], accuracy).collect()}
    for g, part in pdf.groupby("g"):
        for p in PROBS:
            assert got[(g, p)] == pytest.approx(np.quantile(part.v, p), rel=1e-12)


@pytest.mark.parametrize("accuracy", [100, 20000])
def test_global_quantiles(skewed, accuracy):
    values = skewed.toPandas().v
    for r in exact_quantiles(skewed, "v", PROBS, accuracy=accuracy).collect():
        assert r["quantile"] == pytest.approx(np.quantile(values, r["prob"]), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5), st.just(float("nan"))), min_size=1, max_size=30))
def test_quantiles_of_small_tables(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    known = [float(v) for v in values if v is not None and v == v]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", [0.25, 0.75]).collect()}
    if known:
        assert got == {p: pytest.approx(np.quantile(known, p)) for p in (0.25, 0.75)}
    else:
        assert got == {}


def test_null_group_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_quantile_value_beside_rows(skewed):
    n = skewed.withColumn("q", quantile_value(skewed, "v", 0.75)).where("v >= q").count()
    values = skewed.toPandas().v
    assert n == int((values >= np.quantile(values, 0.75)).sum())


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(skewed, descending):
    counts = materialize(skewed.groupBy("g", "v").agg(F.count("*").alias("c")), "test")
    got = running_totals(counts, "v", ["c"], by=["g"], descending=descending, bound=300).toPandas()
    got = got.sort_values("v", ascending=not descending)
    assert (got.groupby("g").c.cumsum() == got.cum_c).all()
    assert got.cum_c.max() == (skewed.toPandas().g == "big").sum()


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_ranges_stay_bounded(spark, n):
    """Ten times the rows give more ranges, not larger ones; heavy values, nulls and long tails included."""
    rows = materialize(
        spark.range(n).select(
            F.when(F.col("id") % 4 == 0, 7.0).when(F.col("id") % 97 == 1, None).otherwise(F.pow(F.pmod(F.xxhash64("id"), F.lit(1009)) / 10.0, 9)).alias("v"),
            F.col("id").alias("t"), F.lit(1).alias("one"), F.lit("g").alias("g"),
        ),
        "test",
    )
    for falls in (False, True):
        placed, ranges = bounded_ranges(rows, ["g"], [("v", falls), ("t", False)], ["one"], bound=40)
        sizes = ranges.toPandas()
        assert sizes["_size"].max() <= 40 and sizes["_size"].sum() == n == sizes["_t_one"].sum()
        assert len(sizes) >= n / 40
        got = placed.toPandas().sort_values(["_range", "v", "t"], ascending=[True, not falls, True])
        known = [(v, t) for v, t in zip(got.v, got.t) if v == v]
        assert known == sorted(known, key=lambda r: (-r[0] if falls else r[0], r[1]))
        assert got.v.isna().to_numpy()[: got.v.isna().sum()].all() != falls


@pytest.mark.parametrize("bound", [20, 1 << 17])
def test_running_totals_with_ties(spark, bound):
    rows = materialize(spark.range(3_000).select((F.col("id") % 3).cast("double").alias("v"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("t"), F.lit(1).alias("one")), "test")
    got = running_totals(rows, "v", ["one"], ties=["t"], bound=bound).toPandas().sort_values(["v", "t"], ascending=[False, True])
    assert got.cum_one.tolist() == list(range(1, 3_001))


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("accuracy,bound", [(100, 15), (1000, 15), (100, 1 << 17)])
def test_quantiles_of_a_power_law(spark, by, accuracy, bound):
    """Brackets far above the bound, most of their width empty."""
    rows = materialize(
        spark.range(8_000).select(F.pow(F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(10_007)) / 100.0, 12).alias("v"), (F.col("id") % 5 == 0).alias("g")), "test"
    )
    pdf = rows.toPandas()
    for r in exact_quantiles(rows, "v", PROBS, by, accuracy, bound).collect():
        part = pdf[pdf.g == r["g"]] if by else pdf
        assert r["quantile"] == pytest.approx(np.quantile(part.v, r["prob"]), rel=1e-12)


def test_running_totals_of_one_value(spark):
    one = spark.createDataFrame([(5.0, 3)], "v double, c long")
    assert running_totals(one, "v", ["c"]).first()["cum_c"] == 3


def test_exact_split_is_exact(spark):
    df = materialize(spark.range(1003).withColumn("y", F.col("id") % 4 == 0), "test")
    assert exact_split(df, "id").where("is_test").count() == 200
    per_class = {r["y"]: r["n"] for r in exact_split(df, "id", by=("y",)).where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert per_class == {True: 50, False: 150}


def test_samples_of_every_size_follow_the_hash(spark):
    df = materialize(spark.range(500), "test")
    order = [r["id"] for r in df.orderBy(sampling.hash_order("id"), "id").collect()]
    for n in (0, 1, 37, 499, 500, 900):
        assert {r["id"] for r in sample_n(df, "id", n).collect()} == set(order[:n])


def test_repeated_keys_and_rows_split_exactly(spark):
    """One key holds most rows, and most of those are equal in every column."""
    df = materialize(spark.range(400).select(F.lit(7).alias("k"), (F.col("id") % 3).alias("v")).union(spark.range(100).select("id", "id")), "test")
    assert exact_split(df, "k", 0.31).where("is_test").count() == 155
    assert exact_split(df, "k", 0.31).count() == 500
    assert sample_n(df, "k", 333).count() == 333
    nulls = materialize(spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "a").alias("y")), "test")
    flagged = exact_split(nulls, "id", 0.5, by=("y",)).where("is_test").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in flagged} == {None: 10, "a": 10}


def test_hash_split_does_not_depend_on_partitions(spark):
    ids = spark.range(1000)
    a = {r["id"] for r in sampling.split(ids.repartition(3), "id")[1].collect()}
    b = {r["id"] for r in sampling.split(ids.repartition(11), "id")[1].collect()}
    assert a == b and 150 < len(a) < 250
