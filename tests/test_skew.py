"""The given tables with one order, customer, product and user holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tests.oracle_check import compare
from tillwise.plans import catalog

QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()
NAMES = [
    "retail_tx", "customer_360", "rfm", "revenue_at_risk", "customer_segments", "clv_trends_quarterly", "geo_city",
    "quantiles", "describe", "duplicate_rows", "value_counts", "roc_auc", "error_percentiles", "feature_info",
]


@pytest.fixture(scope="module")
def skewed(spark, sf, tmp_path_factory):
    """Hot keys: every third line, order and event goes to key 1; every third price is the same."""
    folder = str(tmp_path_factory.mktemp("skew"))
    third = F.pmod(F.xxhash64("seed"), F.lit(3)) == 0
    changes = {
        "lineitem": ("l_shipdate", {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_extendedprice": 1000.0}),
        "orders": ("o_orderkey", {"o_custkey": 1}),
        "events": ("event_id", {"user_id": 1}),
    }
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{sf}/{table}.parquet")
        if table in changes:
            seed, hot = changes[table]
            df = df.withColumn("seed", F.struct(seed, F.monotonically_increasing_id()) if table == "lineitem" else F.col(seed))
            df = df.withColumns(
                {c: F.when(third, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in hot.items()}
            ).drop("seed")
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    con = connect_folders(skewed)
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], skewed) is None


def connect_folders(folder):
    import duckdb
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con
