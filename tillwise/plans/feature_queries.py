"""Catalogue: projections, encoders, features, scaling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import nonzero
from ..operators import encoders, features, projection, sampling, scaling
from . import tables
from .oracle_base import C360, RETAIL_TX, with_
from .shared import customers, rounded

NUMERIC = [
    "quantity", "unit_price", "discount_applied", "days_since_last_purchase", "total_transactions",
    "num_purchases", "website_visits", "online_purchases", "membership_years",
]
_N = ", ".join(NUMERIC)


def _one_hot(spark, d):
    source = tables.customers(spark, d).select("customer_id", "segment", "purchase_frequency", "app_usage_frequency")
    # one level counts as unknown, so that nulls come from the data
    source = source.withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING")))
    cats = ["segment", "purchase_frequency", "app_usage_frequency"]
    return encoders.one_hot(source, encoders.fit_levels(source, cats))


def _dummy_names(spark, d):
    encoded = _one_hot(spark, d)
    names = projection.names_with_prefix(encoded.columns, "segment_")
    return spark.createDataFrame([(n,) for n in names], "level string")


def _c(*columns):
    return lambda spark, d: tables.customers(spark, d).select("customer_id", *columns)


DUMMIES = [
    "gender_Male", "gender_Other", "store_location_ASIA", "customer_city_FRANCE", "store_city_CHINA", "app_usage_Low",
    "app_usage_Medium", "social_media_engagement_Low", "social_media_engagement_Medium", "education_level_High School",
    "education_level_PhD", "marital_status_Single", "product_category_BUILDING", "payment_method_Weekly",
]


def _dummy_requests(spark, d):
    """Requests with every column that sets dummies, derived from the customers."""
    balance, bought = F.col("acct_balance"), F.col("num_purchases")
    return tables.customers(spark, d).select(
        "customer_id", "app_usage_frequency", "social_media_engagement", "customer_city",
        F.when(balance > 5000, "Other").when(balance > 0, "Male").otherwise("Female").alias("gender"),
        F.col("customer_state").alias("store_location"), F.col("customer_city").alias("store_city"),
        F.when(bought > 60, "PhD").when(bought > 30, "High School").otherwise("None").alias("education_level"),
        F.when(F.col("loyalty_program") == "Yes", "Single").otherwise("Widowed").alias("marital_status"),
        F.col("segment").alias("product_category"), F.col("purchase_frequency").alias("payment_method"),
    )


def _interaction(spark, d):
    base = tables.customers(spark, d).select(
        "customer_id", "quantity", "unit_price", "discount_applied", "total_sales",
        F.col("gross_sales").alias("total_spent"),
    )
    no_price = base.drop("quantity", "unit_price")
    return rounded(
        base.select(
            "customer_id",
            features.quantity_times_price(base).alias("quantity_times_price"),
            features.quantity_times_price(base, discounted=True).alias("discounted"),
            features.quantity_times_price(no_price).alias("from_sales"),
            features.quantity_times_price(no_price.drop("total_sales")).alias("from_spent"),
            features.quantity_times_price(no_price.drop("total_sales", "total_spent")).alias("from_nothing"),
        )
    )


def _engagement_train(spark, d):
    base = tables.customers(spark, d)
    encoded = base.select(
        "customer_id", "email_subscriptions",
        *[
            F.when(F.col(c) == v, 1).otherwise(0).alias(n)
            for c, v, n in (
                ("app_usage_frequency", "Low", "app_usage_Low"),
                ("app_usage_frequency", "Medium", "app_usage_Medium"),
                ("social_media_engagement", "Low", "social_media_engagement_Low"),
                ("social_media_engagement", "Medium", "social_media_engagement_Medium"),
            )
        ],
    )
    return encoded.select("customer_id", features.engagement_training(encoded).alias("engagement_score"))


def _engagement_serve(spark, d):
    base = tables.customers(spark, d).withColumn("is_active_member", encoders.binary_map("loyalty_program"))
    fallback = base.select("website_visits", "is_active_member")
    return base.select(
        "customer_id",
        features.engagement_serving(base).alias("engagement_score"),
        features.engagement_serving(fallback).alias("engagement_fallback"),
    )


def _online(spark, d):
    base = tables.customers(spark, d)
    no_store = base.drop("in_store_purchases")
    purchases_only = base.drop("in_store_purchases", "online_purchases")
    return rounded(
        base.select(
            "customer_id",
            features.online_preference(base).alias("online_preference"),
            features.online_preference(no_store).alias("from_purchases"),
            features.online_preference(base.select("customer_id")).alias("unknown"),
            features.engagement_ratio(base).alias("engagement_ratio"),
            features.engagement_ratio(purchases_only).alias("half_split"),
        )
    )


def _value_per_txn(spark, d):
    base = tables.customers(spark, d).withColumnRenamed("total_sales", "total_spent")
    return rounded(base.select("customer_id", features.value_per_transaction(base).alias("value_per_transaction")))


def _requests(spark, d):
    """Scoring requests shaped like the input form, one per customer."""
    return tables.customers(spark, d).select(
        "customer_id",
        F.col("num_purchases"), F.col("avg_purchase_value").alias("avg_purchase"),
        encoders.binary_map("loyalty_program").alias("is_active_member"),
        F.col("customer_support_calls").alias("has_complained"),
        "days_since_last_purchase", F.col("total_sales").alias("total_spent"), "online_purchases",
        "app_usage_frequency", "social_media_engagement",
    )


def _sign(spark, d):
    return tables.customers(spark, d).select("customer_id", scaling.label_sign("churned").alias("sign"))


def _sample_base(spark, d):
    return tables.load(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")


def _stratified(spark, d):
    base = tables.customers(spark, d).select("customer_id", "churned")
    return sampling.exact_split(base, "customer_id", by=("churned",))


ALIGNED = ["quantity", "age", "website_visits", "unit_price", "holiday_season"]

QUERIES = {
    "one_hot": _one_hot,
    "dummy_names": _dummy_names,
    "binary_map": lambda spark, d: encoders.map_yes_no(_c("loyalty_program", "email_subscriptions")(spark, d)),
    "ternary_map": lambda spark, d: tables.load(spark, d, "orders").select(
        "o_orderkey",
        encoders.code_map("o_orderstatus", {"F": 1, "O": 0, "P": 2}).alias("status_code"),
        encoders.code_map("o_orderstatus", {"F": 1, "O": 0}).alias("partial_code"),
    ),
    "interaction": _interaction,
    "engagement_train": _engagement_train,
    "engagement_serve": _engagement_serve,
    "recency": lambda spark, d: (
        lambda b: rounded(
            b.select(
                "customer_id",
                features.recency_ratio(b).alias("recency_ratio"),
                features.recency_score("days_since_last_purchase").alias("recency_score"),
                features.recency_ratio(b.select("customer_id")).alias("recency_absent"),
            ),
            6,
        )
    )(_c("days_since_last_purchase")(spark, d)),
    "online_preference": _online,
    "value_per_txn": _value_per_txn,
    "targets": lambda spark, d: (
        lambda b: rounded(
            b.select(
                "customer_id",
                features.sales_target(b).alias("sales_target"),
                features.churn_label("days_since_last_purchase", F.col("purchase_frequency") == "Yearly").alias(
                    "churn_target"
                ),
            )
        )
    )(_c("quantity", "unit_price", "discount_applied", "days_since_last_purchase", "purchase_frequency")(spark, d)),
    "buckets": lambda spark, d: tables.customers(spark, d)
    .select(
        encoders.income_bracket(F.col("acct_balance") * 10).alias("income_bracket"),
        encoders.purchase_frequency("num_purchases").alias("purchase_frequency"),
    )
    .groupBy("income_bracket", "purchase_frequency")
    .agg(F.count("*").alias("customers")),
    "known_level_dummies": lambda spark, d: encoders.request_dummies(_dummy_requests(spark, d), DUMMIES).select(
        "customer_id", *DUMMIES
    ),
    "alias_map": lambda spark, d: rounded(
        features.map_request_fields(_requests(spark, d)).drop("app_usage_frequency", "social_media_engagement")
    ),
    "request_features": lambda spark, d: rounded(
        features.request_features(
            _requests(spark, d),
            ["total_transactions", "avg_purchase_value", "loyalty_program", "customer_support_calls",
             "recency_ratio", "recency_score", "quantity_times_price", "value_per_transaction",
             "engagement_score", "engagement_ratio", "app_usage_Low", "unit_price",
             "purchase_frequency_Weekly"],
        ),
        6,
    ),
    "calculated_clv": lambda spark, d: rounded(
        _c("total_transactions", "avg_purchase_value", "total_sales")(spark, d).select(
            "customer_id", features.calculated_clv("total_transactions", "avg_purchase_value").alias("calculated_clv")
        )
    ),
    "form_values": lambda spark, d: rounded(
        features.form_values(
            _c("quantity", "unit_price", "discount_applied", "num_purchases", "online_purchases")(spark, d)
        ).select("customer_id", "total_spent", "in_store", "avg_purchase")
    ),
    "mean_impute": lambda spark, d: rounded(
        scaling.mean_impute(
            customers(spark, d, "customer_id", "website_visits", "acct_balance").select(
                "customer_id",
                F.nullif(F.col("website_visits"), F.lit(0)).alias("website_visits"),
                F.when(F.col("acct_balance") >= 0, F.col("acct_balance")).otherwise(float("nan")).alias("acct_balance"),
            ),
            ["website_visits", "acct_balance"],
        )
    ),
    "zscore": lambda spark, d: rounded(
        scaling.zscore(
            customers(spark, d, "customer_id", "quantity", "acct_balance").withColumn("constant", F.lit(3.0)),
            ["quantity", "acct_balance", "constant"],
        ),
        6,
    ),
    "target_scale": lambda spark, d: rounded(
        scaling.scale_target(customers(spark, d, "customer_id", "total_sales"), "total_sales", "scaled", "restored").drop(
            "total_sales"
        )
    ),
    "label_sign": _sign,
    "poly2": lambda spark, d: rounded(
        scaling.polynomial_expand(
            _c("quantity", "membership_years", "total_transactions")(spark, d),
            ["quantity", "membership_years", "total_transactions"], 2, keep=["customer_id"],
        )
    ),
    "class_weights": lambda spark, d: rounded(
        scaling.class_weights(tables.customers(spark, d).select("churned"), "churned"), 6
    ),
    "best_feature": lambda spark, d: rounded(
        scaling.best_feature(tables.customers(spark, d).select(*NUMERIC, "total_sales"), NUMERIC, "total_sales"), 6
    ),
    "frequency_encode": lambda spark, d: rounded(
        encoders.frequency_encode(
            tables.load(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
            "o_orderpriority", "priority_share",
        ).withColumn(
            "priority_rank",
            encoders.ordinal_encode("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
        ),
        6,
    ),
    "align_features": lambda spark, d: rounded(
        projection.align_features(tables.customers(spark, d), ALIGNED, keep=["customer_id"])
    ),
    "coerce_numeric": lambda spark, d: tables.load(spark, d, "part").select(
        "p_partkey",
        projection.coerce_numeric(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))).alias("brand_number"),
        projection.coerce_numeric("p_name").alias("name_number"),
    ),
    "defaults": lambda spark, d: (
        lambda b: b.select(
            "customer_id", "website_visits",
            *[F.col(c).alias(f"{c}_default") for c in ("online_purchases", "customer_support_calls")],
        ).join(
            features.apply_defaults(
                _c("online_purchases", "customer_support_calls")(spark, d), null_only=True
            ).withColumnsRenamed({"online_purchases": "online_kept", "customer_support_calls": "calls_kept"}),
            "customer_id",
        )
    )(features.apply_defaults(_c("website_visits", "online_purchases", "customer_support_calls")(spark, d))),
    "customer_filter": lambda spark, d: projection.customer_filter(
        _c("membership_years", "segment", "avg_purchase_value")(spark, d),
        age_min=2, age_max=6, income_level="AUTOMOBILE", min_purchase_value=30000.0,
        age="membership_years", income="segment",
    ).select("customer_id", "membership_years"),
    "projection_filters": lambda spark, d: rounded(
        projection.rename(
            projection.drop_targets(
                tables.retail_tx(spark, d).where(
                    (F.col("quantity") >= 10)
                    & (F.col("quantity") <= 40)
                    & F.col("payment_method").isin("1-URGENT", "2-HIGH")
                    & ~F.col("customer_state").isin("ASIA")
                )
            ).drop("customer_id", "product_id")
        ).select("order_id", "city", "country", *["quantity", "discount_applied", "returned"],
                 (F.col("returned") / nonzero("discount_applied")).alias("per_discount"))
    ),
    "sorted_levels": lambda spark, d: projection.sorted_levels(
        tables.load(spark, d, "part").withColumnRenamed("p_type", "level"), "level"
    ),
    "hash_split": lambda spark, d: _sample_base(spark, d).select(
        "customer_id",
        sampling.hash_bucket("customer_id").alias("bucket"),
        sampling.in_share("customer_id", 0.2).alias("is_test"),
    ),
    "exact_split": lambda spark, d: sampling.exact_split(_sample_base(spark, d), "customer_id"),
    "stratified_split": _stratified,
    "sample_n": lambda spark, d: sampling.sample_n(_sample_base(spark, d), "customer_id", 100),
    "sample_lines": lambda spark, d: sampling.sample_n(
        tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 100_001
    ).groupBy("l_orderkey").agg(F.count("*").alias("lines")).where("lines > 0").agg(
        F.sum("lines").alias("lines"), F.count("*").alias("orders")
    ),
    "train_val": lambda spark, d: sampling.split(_sample_base(spark, d), "customer_id", 0.2)[0].select(
        "customer_id", sampling.in_share("customer_id", 0.15, seed=7).alias("is_validation")
    ),
}

_BUCKET = "('0x' || substr(md5(c_custkey::varchar || '|{seed}'), 1, 8))::bigint % 10000"
_ORDER = "('0x' || substr(md5({key}::varchar || '|42'), 1, 15))::bigint"
_SEGMENTS = ["FURNITURE", "HOUSEHOLD", "MACHINERY"]  # levels after AUTOMOBILE, the dropped first one


def _req(expr: str) -> str:
    return f"round({expr}, 6)"


ORACLES = {
    "one_hot": with_(
        C360,
        "SELECT customer_id, "
        + ", ".join(
            f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\""
            for c, vs in (
                ("segment", _SEGMENTS),
                ("purchase_frequency", ["Weekly", "Yearly"]),
                ("app_usage_frequency", ["Low", "Medium"]),
            )
            for v in vs
        )
        + " FROM c360",
    ),
    "dummy_names": "SELECT c_mktsegment AS level FROM customer WHERE c_mktsegment NOT IN "
    "('BUILDING', (SELECT min(c_mktsegment) FROM customer)) GROUP BY 1",
    "binary_map": with_(
        C360,
        "SELECT customer_id, CASE loyalty_program WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS loyalty_program, "
        "email_subscriptions FROM c360",
    ),
    "ternary_map": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 2 END "
    "AS status_code, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS partial_code FROM orders",
    "interaction": with_(
        C360,
        "SELECT customer_id, round(quantity * unit_price, 4) AS quantity_times_price, "
        "round(quantity * unit_price * (1 - discount_applied), 4) AS discounted, round(total_sales, 4) AS from_sales, "
        "round(gross_sales, 4) AS from_spent, round(0.0::double, 4) AS from_nothing FROM c360",
    ),
    "engagement_train": with_(
        C360,
        "SELECT customer_id, ((app_usage_frequency = 'Medium')::integer + email_subscriptions) / 4.0::double "
        "AS engagement_score FROM c360",
    ),
    "engagement_serve": with_(
        C360,
        "SELECT customer_id, ((app_usage_frequency IN ('Medium', 'High'))::integer "
        "+ (social_media_engagement = 'High')::integer + email_subscriptions) / 4.0::double AS engagement_score, "
        "((website_visits > 5)::integer + (loyalty_program = 'Yes')::integer) / 4.0::double AS engagement_fallback "
        "FROM c360",
    ),
    "recency": with_(
        C360,
        "SELECT customer_id, round(days_since_last_purchase / 365.0::double, 6) AS recency_ratio, "
        "round(1.0::double / (days_since_last_purchase + 1), 6) AS recency_score, "
        "round(0.0::double, 6) AS recency_absent FROM c360",
    ),
    "online_preference": with_(
        C360,
        "SELECT customer_id, round(online_purchases / (online_purchases + in_store_purchases + 1), 4) "
        "AS online_preference, round(online_purchases / (num_purchases + 1), 4) AS from_purchases, "
        "round(0.5::double, 4) AS unknown, "
        "round(online_purchases / greatest(online_purchases + in_store_purchases, 1), 4) AS engagement_ratio, "
        "round(CASE WHEN num_purchases = 0 THEN 0.0::double ELSE 0.5::double END, 4) AS half_split FROM c360",
    ),
    "value_per_txn": with_(
        C360,
        "SELECT customer_id, round(total_sales / greatest(num_purchases, 1), 4) AS value_per_transaction FROM c360",
    ),
    "targets": with_(
        C360,
        "SELECT customer_id, round(quantity * unit_price * (1 - discount_applied), 4) AS sales_target, "
        "churned AS churn_target FROM c360",
    ),
    "buckets": with_(
        C360,
        "SELECT CASE WHEN acct_balance * 10 < 30000 THEN 'Low' WHEN acct_balance * 10 < 70000 THEN 'Medium' "
        "ELSE 'High' END AS income_bracket, purchase_frequency, count(*) AS customers FROM c360 GROUP BY 1, 2",
    ),
    "known_level_dummies": with_(
        C360,
        """, r AS (
  SELECT customer_id, app_usage_frequency AS app, social_media_engagement AS social, customer_city AS city,
         segment AS category, purchase_frequency AS payment,
         CASE WHEN acct_balance > 5000 THEN 'Other' WHEN acct_balance > 0 THEN 'Male' ELSE 'Female' END AS gender,
         CASE WHEN num_purchases > 60 THEN 'PhD' WHEN num_purchases > 30 THEN 'High School' ELSE 'None' END AS edu,
         CASE loyalty_program WHEN 'Yes' THEN 'Single' ELSE 'Widowed' END AS marital, customer_state AS place
  FROM c360
)
SELECT customer_id, (gender = 'Male')::integer AS "gender_Male", (gender = 'Other')::integer AS "gender_Other",
  (place = 'ASIA')::integer AS "store_location_ASIA", (city = 'FRANCE')::integer AS "customer_city_FRANCE",
  (city = 'CHINA')::integer AS "store_city_CHINA", (app = 'Low')::integer AS "app_usage_Low",
  (app = 'Medium')::integer AS "app_usage_Medium", (social = 'Low')::integer AS "social_media_engagement_Low",
  (social = 'Medium')::integer AS "social_media_engagement_Medium",
  (edu = 'High School')::integer AS "education_level_High School", (edu = 'PhD')::integer AS "education_level_PhD",
  (marital = 'Single')::integer AS "marital_status_Single",
  (category = 'BUILDING')::integer AS "product_category_BUILDING", (payment = 'Weekly')::integer AS "payment_method_Weekly"
FROM r""",
    ),
    "alias_map": with_(
        C360,
        "SELECT customer_id, round(num_purchases::double, 4) AS num_purchases, "
        "round(avg_purchase_value, 4) AS avg_purchase, round((loyalty_program = 'Yes')::integer::double, 4) "
        "AS is_active_member, round(customer_support_calls::double, 4) AS has_complained, "
        "round(days_since_last_purchase::double, 4) AS days_since_last_purchase, round(total_sales, 4) AS total_spent, "
        "round(online_purchases::double, 4) AS online_purchases, round(num_purchases::double, 4) AS total_transactions, "
        "round(avg_purchase_value, 4) AS avg_transaction_value, round(avg_purchase_value, 4) AS avg_purchase_value, "
        "round((loyalty_program = 'Yes')::integer::double, 4) AS loyalty_program, "
        "round(customer_support_calls::double, 4) AS customer_support_calls FROM c360",
    ),
    "request_features": with_(
        C360,
        ", r AS (SELECT *, num_purchases * 0.5::double AS half, "
        "((app_usage_frequency IN ('Medium', 'High'))::integer + (social_media_engagement = 'High')::integer "
        "+ (loyalty_program = 'Yes')::integer) / 4.0::double AS eng FROM c360) SELECT customer_id, "
        + _req("CASE WHEN num_purchases = 0 THEN 20.0::double ELSE num_purchases END")
        + " AS total_transactions, "
        + _req("CASE WHEN coalesce(avg_purchase_value, 0) = 0 THEN 200.0::double ELSE avg_purchase_value END")
        + " AS avg_purchase_value, "
        + _req("(loyalty_program = 'Yes')::integer::double")
        + " AS loyalty_program, "
        + _req("CASE WHEN customer_support_calls = 0 THEN 2.0::double ELSE customer_support_calls END")
        + " AS customer_support_calls, "
        + _req("coalesce(days_since_last_purchase / 365.0::double, 0)")
        + " AS recency_ratio, "
        + _req("coalesce(1.0::double / (days_since_last_purchase + 1), 0)")
        + " AS recency_score, "
        + _req("total_sales")
        + " AS quantity_times_price, "
        + _req("total_sales / greatest(num_purchases, 1)")
        + " AS value_per_transaction, "
        + _req("eng")
        + " AS engagement_score, "
        + _req("online_purchases / CASE WHEN online_purchases + half = 0 THEN 1 ELSE online_purchases + half END")
        + " AS engagement_ratio, "
        + _req("(app_usage_frequency = 'Low')::integer::double")
        + ' AS "app_usage_Low", '
        + _req("100.0::double")
        + " AS unit_price, "
        + _req("(num_purchases >= 50)::integer::double")
        + ' AS "purchase_frequency_Weekly" FROM r',
    ),
    "calculated_clv": with_(
        C360,
        "SELECT customer_id, round(total_transactions * avg_purchase_value, 4) AS calculated_clv FROM c360",
    ),
    "form_values": with_(
        C360,
        "SELECT customer_id, round(quantity * unit_price * (1 - discount_applied), 4) AS total_spent, "
        "num_purchases - online_purchases AS in_store, "
        "round(quantity * unit_price * (1 - discount_applied) / greatest(num_purchases, 1), 4) AS avg_purchase FROM c360",
    ),
    "mean_impute": with_(
        C360,
        "SELECT customer_id, round(coalesce(nullif(website_visits, 0), "
        "(SELECT avg(website_visits) FROM c360 WHERE website_visits > 0)), 4) AS website_visits, "
        "round(CASE WHEN acct_balance >= 0 THEN acct_balance "
        "ELSE (SELECT avg(acct_balance) FROM c360 WHERE acct_balance >= 0) END, 4) AS acct_balance FROM c360",
    ),
    "zscore": with_(
        C360,
        ", s AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(acct_balance) AS ma, "
        "stddev_pop(acct_balance) AS sa FROM c360) SELECT customer_id, round((quantity - mq) / sq, 6) AS quantity, "
        "round((acct_balance - ma) / sa, 6) AS acct_balance, round(0.0::double, 6) AS constant FROM c360, s",
    ),
    "target_scale": with_(
        C360,
        ", s AS (SELECT avg(total_sales) AS m, stddev_pop(total_sales) AS sd FROM c360) "
        "SELECT customer_id, round((total_sales - m) / sd, 4) AS scaled, round(total_sales, 4) AS restored FROM c360, s",
    ),
    "label_sign": with_(C360, "SELECT customer_id, CASE WHEN churned = 1 THEN 1 ELSE -1 END AS sign FROM c360"),
    "poly2": with_(
        C360,
        ", x AS (SELECT customer_id, quantity::double AS quantity, membership_years::double AS membership_years, "
        "total_transactions::double AS total_transactions FROM c360) SELECT customer_id, "
        + ", ".join(
            f'round({a}, 4) AS "{a}"' for a in ("quantity", "membership_years", "total_transactions")
        )
        + ", "
        + ", ".join(
            f'round({a} * {b}, 4) AS "{a}*{b}"'
            for a, b in (
                ("quantity", "quantity"), ("quantity", "membership_years"), ("quantity", "total_transactions"),
                ("membership_years", "membership_years"), ("membership_years", "total_transactions"),
                ("total_transactions", "total_transactions"),
            )
        )
        + " FROM x",
    ),
    "class_weights": with_(
        C360,
        ", n AS (SELECT count(*) FILTER (churned = 1) AS p, count(*) FILTER (churned = 0) AS q FROM c360) "
        "SELECT p AS positives, q AS negatives, round(q / p, 6) AS margin_positive_cost, "
        "round(1.0::double, 6) AS margin_negative_cost, round(q / p, 6) AS network_positive_weight, "
        "round(0.5::double / p, 6) AS boosting_positive_weight, round(0.5::double / q, 6) AS boosting_negative_weight FROM n",
    ),
    "best_feature": with_(
        C360,
        ", r AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, total_sales) AS r FROM c360" for c in NUMERIC)
        + ") SELECT feature, round(r, 6) AS correlation FROM r ORDER BY abs(r) DESC, feature LIMIT 1",
    ),
    "frequency_encode": "SELECT o_orderkey, o_orderpriority, "
    "round(count(*) OVER (PARTITION BY o_orderpriority) / (SELECT count(*) FROM orders), 6) AS priority_share, "
    "substr(o_orderpriority, 1, 1)::integer - 1 AS priority_rank FROM orders",
    "align_features": with_(
        C360,
        "SELECT customer_id, round(quantity::double, 4) AS quantity, round(0.0::double, 4) AS age, "
        "round(website_visits::double, 4) AS website_visits, round(coalesce(unit_price, 0), 4) AS unit_price, "
        "round(0.0::double, 4) AS holiday_season FROM c360",
    ),
    "coerce_numeric": "SELECT p_partkey, coalesce(try_cast(replace(p_brand, 'Brand#', '') AS double), 0) "
    "AS brand_number, coalesce(try_cast(p_name AS double), 0) AS name_number FROM part",
    "defaults": with_(
        C360,
        "SELECT customer_id, website_visits, "
        "CASE WHEN online_purchases = 0 THEN 10.0::double ELSE online_purchases END AS online_purchases_default, "
        "CASE WHEN customer_support_calls = 0 THEN 2.0::double ELSE customer_support_calls END "
        "AS customer_support_calls_default, online_purchases::double AS online_kept, "
        "customer_support_calls::double AS calls_kept FROM c360",
    ),
    "customer_filter": with_(
        C360,
        "SELECT customer_id, membership_years FROM c360 WHERE membership_years BETWEEN 2 AND 6 "
        "AND segment = 'AUTOMOBILE' AND avg_purchase_value >= 30000",
    ),
    "projection_filters": with_(
        RETAIL_TX,
        "SELECT order_id, customer_city AS city, customer_state AS country, round(quantity, 4) AS quantity, "
        "round(discount_applied, 4) AS discount_applied, returned, "
        "round(returned / CASE WHEN discount_applied = 0 THEN 1 ELSE discount_applied END, 4) AS per_discount "
        "FROM retail_tx WHERE quantity BETWEEN 10 AND 40 AND payment_method IN ('1-URGENT', '2-HIGH') "
        "AND customer_state NOT IN ('ASIA')",
    ),
    "sorted_levels": "SELECT DISTINCT p_type AS level FROM part ORDER BY 1",
    "hash_split": f"SELECT c_custkey AS customer_id, {_BUCKET.format(seed=42)} AS bucket, "
    f"{_BUCKET.format(seed=42)} < 2000 AS is_test FROM customer",
    "exact_split": f"SELECT c_custkey AS customer_id, c_mktsegment, row_number() OVER (ORDER BY "
    f"{_ORDER.format(key='c_custkey')}, c_custkey) <= floor((SELECT count(*) FROM customer) * 0.2::double) AS is_test FROM customer",
    "stratified_split": with_(
        C360,
        f"SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY "
        f"{_ORDER.format(key='customer_id')}, customer_id) <= floor(count(*) OVER (PARTITION BY churned) * 0.2::double) "
        "AS is_test FROM c360",
    ),
    # whole orders are taken in the order of their hash, the last one perhaps in part
    "sample_lines": f"WITH o AS (SELECT l_orderkey, count(*) AS c, {_ORDER.format(key='l_orderkey')} AS h FROM lineitem GROUP BY 1), "
    "u AS (SELECT *, sum(c) OVER (ORDER BY h, l_orderkey) - c AS before FROM o) "
    "SELECT sum(least(c, 100001 - before))::bigint AS lines, count(*) AS orders FROM u WHERE before < 100001",
    "sample_n": f"SELECT c_custkey AS customer_id, c_mktsegment FROM customer ORDER BY "
    f"{_ORDER.format(key='c_custkey')}, c_custkey LIMIT 100",
    "train_val": f"SELECT c_custkey AS customer_id, {_BUCKET.format(seed=7)} < 1500 AS is_validation FROM customer "
    f"WHERE {_BUCKET.format(seed=42)} >= 2000",
}
