"""The two derived tables: ``retail_tx`` (line grain) and ``customer_360``.

``customers`` is ``customer_360`` written once per session and source folder, the
way a feature table is: the facts are joined and reduced one time, and every
customer query after that reads the columns it needs from Parquet.

Shape of the plan at scale. ``customer_360`` never joins raw lines to
customers: lines are first reduced per order with map-side combine (so a hot
order collapses before the shuffle), the reduced rows meet ``orders`` on the
order key they are already partitioned by, and the result is reduced per
customer. Fact rows therefore cross the network once, already aggregated.
Small dimensions carry no broadcast hint; Spark broadcasts them only while
their measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numeric import flag
from ..operators import features
from ..operators.encoders import level_by_threshold
from ..session import write_stage


SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
CUSTOMER_SOURCES = ["region", "nation", "customer", "orders", "lineitem", "events"]

_schemas: dict[str, tuple[tuple, T.StructType]] = {}


def source_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Length, number of files and modification time of a source: what changes when it is written again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(target)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(target).getModificationTime()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table. Its schema is read from the files once and reused while they stay as they are."""
    path = f"{sf_dir}/{name}.parquet"
    state = source_state(spark, path)
    if path not in _schemas or _schemas[path][0] != state:
        _schemas[path] = (state, spark.read.parquet(path).schema)
    return spark.read.schema(_schemas[path][1]).parquet(path)


def retail_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its order, product, store and customer place.

    Orders meet their customers before they meet the lines, so the lines, by far
    the largest input, are not shuffled once more for the customer key. Hot
    product or supplier keys are split by the adaptive skew join.
    """
    line = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders")
    part = load(spark, sf_dir, "part")
    nation = load(spark, sf_dir, "nation")
    store = (
        load(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("store_city"))
    )
    placed = orders.join(customer_place(spark, sf_dir), F.col("o_custkey") == F.col("customer_id"))
    return (
        line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(store, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "customer_id",
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_type").alias("product_category"),
            F.col("p_brand").alias("product_brand"),
            F.col("p_size").alias("product_size"),
            F.col("o_orderpriority").alias("payment_method"),
            "store_city",
            "customer_city",
            "customer_state",
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_discount").alias("discount_applied"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_sales"),
            flag(F.col("l_returnflag") == "R").alias("returned"),
            F.col("o_orderdate").alias("transaction_date"),
        )
    )


def customer_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    return (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("acct_balance"),
        )
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: order and line counts, money, discounts, returns, dates."""
    per_order = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("lines"),
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_extendedprice").alias("gross"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
            F.sum("l_discount").alias("discount"),
            F.sum(flag(F.col("l_returnflag") == "R")).alias("returned"),
        )
    )
    return (
        load(spark, sf_dir, "orders")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum("lines").alias("num_purchases"),
            F.sum("quantity").alias("quantity"),
            F.sum("gross").alias("gross_sales"),
            F.sum("net").alias("total_sales"),
            F.sum("discount").alias("discount"),
            F.sum("returned").alias("returned"),
            F.min("o_orderdate").alias("first_purchase_date"),
            F.max("o_orderdate").alias("last_purchase_date"),
        )
    )


def web_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("customer_id"))
        .agg(
            F.count_if(kind.isin("view", "click")).alias("website_visits"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "purchase").alias("online_purchases"),
            F.count_if(kind == "error").alias("customer_support_calls"),
            F.count_if(kind == "signup").alias("signups"),
        )
    )


def reference_date(spark: SparkSession, sf_dir: str):
    """Latest order date, as a scalar subquery over one pruned column."""
    return load(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("d")).scalar()


def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: place, purchase history, web activity, churn label."""
    as_of = reference_date(spark, sf_dir)
    joined = (
        customer_place(spark, sf_dir)
        .join(order_history(spark, sf_dir), "customer_id", "left")
        .join(web_activity(spark, sf_dir), "customer_id", "left")
        .fillna(
            0,
            subset=[
                "total_transactions", "num_purchases", "quantity", "gross_sales", "total_sales",
                "discount", "returned", "website_visits", "clicks", "online_purchases",
                "customer_support_calls", "signups",
            ],
        )
    )
    lines = F.col("num_purchases")
    table = joined.select(
        "customer_id", "customer_city", "customer_state", "segment", "acct_balance",
        F.when(F.col("acct_balance") > 0, "Yes").otherwise("No").alias("loyalty_program"),
        "total_transactions",
        F.col("total_transactions").alias("in_store_purchases"),
        "num_purchases", "quantity", "gross_sales", "total_sales",
        F.try_divide(F.col("gross_sales"), F.col("quantity")).alias("unit_price"),
        F.try_divide(F.col("total_sales"), lines).alias("avg_purchase_value"),
        F.try_divide(F.col("discount"), lines).alias("discount_applied"),
        F.try_divide(F.col("returned"), lines).alias("product_return_rate"),
        "last_purchase_date",
        F.datediff(as_of, F.col("last_purchase_date")).alias("days_since_last_purchase"),
        F.coalesce(
            F.floor(F.datediff(as_of, F.col("first_purchase_date")) / F.lit(365.0)), F.lit(0)
        ).cast("int").alias("membership_years"),
        level_by_threshold(lines, [(50, "Weekly"), (20, "Monthly")], "Yearly").alias("purchase_frequency"),
        "website_visits", "online_purchases", "customer_support_calls",
        level_by_threshold(F.col("website_visits"), [(31, "High"), (24, "Medium")], "Low").alias("app_usage_frequency"),
        level_by_threshold(F.col("clicks"), [(16, "High"), (12, "Medium")], "Low").alias("social_media_engagement"),
        flag(F.col("signups") >= 13).alias("email_subscriptions"),
    )
    return table.withColumn(
        "churned",
        features.churn_label("days_since_last_purchase", F.col("purchase_frequency") == "Yearly"),
    )


_stored: dict[tuple, str] = {}


def customers(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The stored customer table; built again when a source has changed, or on ``refresh``.

    A table that is no longer in the shared folder is built again.
    """
    if refresh:
        _schemas.clear()
    states = tuple(source_state(spark, f"{sf_dir}/{t}.parquet") for t in CUSTOMER_SOURCES)
    key = (spark.sparkContext.applicationId, sf_dir, states)
    if not refresh and key in _stored:
        try:
            return spark.read.parquet(_stored[key])
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    _stored[key] = write_stage(customer_360(spark, sf_dir), "customers")
    return spark.read.parquet(_stored[key])


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency and monetary value per customer with orders."""
    as_of = reference_date(spark, sf_dir)
    return order_history(spark, sf_dir).select(
        "customer_id",
        F.datediff(as_of, F.col("last_purchase_date")).alias("recency_days"),
        F.col("total_transactions").alias("frequency"),
        F.coalesce(F.try_divide("total_sales", "total_transactions"), F.lit(0.0)).alias("monetary"),
    )
