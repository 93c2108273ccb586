"""Derived features and targets.

Training and serving use different forms of some features; each variant is its
own function or flag. Fallback chains depend on which columns a table has,
so they are resolved from the schema when the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import as_col, at_least_one, flag, nonzero

# The 43 numeric features of the churn models.
MODEL_FEATURES = [
    "age", "loyalty_program", "membership_years", "number_of_children", "quantity",
    "unit_price", "discount_applied", "transaction_hour", "week_of_year", "month_of_year",
    "avg_purchase_value", "avg_discount_used", "online_purchases", "in_store_purchases",
    "avg_items_per_transaction", "avg_transaction_value", "total_returned_items",
    "total_returned_value", "total_transactions", "total_items_purchased",
    "total_discounts_received", "avg_spent_per_category", "max_single_purchase_value",
    "min_single_purchase_value", "product_rating", "product_review_count", "product_stock",
    "product_return_rate", "product_weight", "product_shelf_life", "customer_zip_code",
    "store_zip_code", "distance_to_store", "holiday_season", "weekend",
    "customer_support_calls", "email_subscriptions", "website_visits",
    "days_since_last_purchase", "quantity_times_price", "engagement_score", "recency_ratio",
    "online_preference",
]
# What a feature is set to when a request leaves it out or at zero.
FEATURE_DEFAULTS = {
    "loyalty_program": 0.0, "membership_years": 1.0, "number_of_children": 0.0,
    "transaction_date": 2021.0, "quantity": 5.0, "unit_price": 100.0, "discount_applied": 0.1,
    "transaction_hour": 12.0, "week_of_year": 26.0, "month_of_year": 6.0,
    "avg_purchase_value": 200.0, "last_purchase_date": 2021.0, "avg_discount_used": 0.15,
    "online_purchases": 10.0, "in_store_purchases": 15.0, "avg_items_per_transaction": 3.0,
    "avg_transaction_value": 150.0, "total_returned_items": 1.0, "total_returned_value": 50.0,
    "total_transactions": 20.0, "total_items_purchased": 60.0, "total_discounts_received": 100.0,
    "avg_spent_per_category": 200.0, "max_single_purchase_value": 500.0,
    "min_single_purchase_value": 10.0, "product_rating": 3.5, "product_review_count": 100.0,
    "product_stock": 50.0, "product_return_rate": 0.1, "product_weight": 1.0,
    "product_manufacture_date": 2020.0, "product_expiry_date": 2023.0,
    "product_shelf_life": 365.0, "promotion_start_date": 2021.0, "promotion_end_date": 2021.0,
    "customer_zip_code": 10001.0, "store_zip_code": 10001.0, "distance_to_store": 10.0,
    "holiday_season": 0.0, "weekend": 0.0, "customer_support_calls": 2.0,
    "email_subscriptions": 1.0,
}
# Request fields taken over as numbers under their own name.
NUMERIC_REQUEST_FIELDS = [
    "age", "income", "total_spent", "num_purchases", "avg_purchase", "days_since_last_purchase",
    "website_visits", "has_complained", "is_active_member", "online_purchases",
    "in_store_purchases", "email_subscriptions", "distance_to_store", "product_return_rate",
    "quantity", "unit_price", "discount_applied",
]
# Model feature -> request field it is read from.
REQUEST_ALIASES = {
    "total_transactions": "num_purchases",
    "avg_transaction_value": "avg_purchase",
    "avg_purchase_value": "avg_purchase",
    "loyalty_program": "is_active_member",
    "customer_support_calls": "has_complained",
}


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def quantity_times_price(df: DataFrame, discounted: bool = False) -> Column:
    """Quantity x price, else total sales, else total spent, else 0."""
    if has(df, "quantity", "unit_price"):
        value = F.col("quantity") * F.col("unit_price")
        if discounted and has(df, "discount_applied"):
            value = value * (1 - F.coalesce(F.col("discount_applied"), F.lit(0.0)))
        return value
    for name in ("total_sales", "total_spent"):
        if has(df, name):
            return F.col(name).cast("double")
    return F.lit(0.0)


def engagement_training(df: DataFrame) -> Column:
    """Quarter of the sum of four training dummies; absent ones count zero."""
    parts = ["app_usage_Medium", "app_usage_High", "social_media_engagement_High", "email_subscriptions"]
    present = [F.col(c).cast("double") for c in parts if has(df, c)]
    value = F.lit(0.0)
    for p in present:
        value = value + p
    return value / F.lit(4.0)


def engagement_serving(df: DataFrame) -> Column:
    """App use Medium/High + social High + mail subscription, over four.

    Without app use, more than five website visits count; without a mail
    subscription, an active membership counts.
    """
    app = social = mail = F.lit(0.0)
    if has(df, "app_usage_frequency"):
        app = flag(F.col("app_usage_frequency").isin("Medium", "High"))
    elif has(df, "website_visits"):
        app = flag(F.col("website_visits") > 5)
    if has(df, "social_media_engagement"):
        social = flag(F.col("social_media_engagement") == "High")
    if has(df, "email_subscriptions"):
        mail = F.col("email_subscriptions").cast("double")
    elif has(df, "is_active_member"):
        mail = flag(F.col("is_active_member") != 0)
    return (app + social + mail) / F.lit(4.0)


def recency_ratio(df: DataFrame, column: str = "days_since_last_purchase") -> Column:
    return F.col(column) / F.lit(365.0) if has(df, column) else F.lit(0.0)


def recency_score(days: str | Column) -> Column:
    return F.lit(1.0) / (as_col(days) + 1)


def online_preference(df: DataFrame) -> Column:
    """Online share with one added to the denominator; 0.5 when unknown."""
    if has(df, "online_purchases", "in_store_purchases"):
        return F.col("online_purchases") / (F.col("online_purchases") + F.col("in_store_purchases") + 1)
    if has(df, "online_purchases", "num_purchases"):
        return F.col("online_purchases") / (F.col("num_purchases") + 1)
    return F.lit(0.5)


def engagement_ratio(df: DataFrame) -> Column:
    """Plain online share; missing parts are half of ``num_purchases``, an empty total counts one."""

    def part(name: str) -> Column:
        if has(df, name):
            return F.col(name).cast("double")
        return F.col("num_purchases") * F.lit(0.5) if has(df, "num_purchases") else F.lit(0.0)

    online = part("online_purchases")
    return online / nonzero(online + part("in_store_purchases"))


def value_per_transaction(df: DataFrame) -> Column:
    """Spend per purchase; no purchases count as one."""
    if has(df, "total_spent"):
        spent = F.col("total_spent").cast("double")
    elif has(df, "quantity_times_price"):
        spent = F.col("quantity_times_price")
    else:
        spent = quantity_times_price(df)
    return spent / at_least_one("num_purchases") if has(df, "num_purchases") else spent


def gaussian(key: str | Column, seed: int, mean: float, std: float) -> Column:
    """Normal draw that depends only on the row key, not on partitioning."""

    def uniform(salt: int) -> Column:
        bits = F.pmod(F.xxhash64(as_col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 52))
        return (bits + 1) / F.lit(float((1 << 52) + 1))

    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(1)))
    return F.lit(mean) + F.lit(std) * radius * F.cos(F.lit(6.283185307179586) * uniform(2))


def sales_target(df: DataFrame, noise_key: str | None = None, seed: int = 42) -> Column:
    """quantity x price x (1 - discount), optionally with 2 % multiplicative noise."""
    value = quantity_times_price(df, discounted=True)
    return value * gaussian(noise_key, seed, 1.0, 0.02) if noise_key else value


def churn_score(days: str | Column, is_yearly: Column) -> Column:
    ratio = F.coalesce(as_col(days) / F.lit(365.0), F.lit(0.5))
    return 0.7 * ratio + 0.3 * (0.8 * flag(is_yearly))


def churn_label(
    days: str | Column, is_yearly: Column, noise_key: str | None = None, seed: int = 42
) -> Column:
    """1 when 0.7 recency + 0.3 x 0.8 yearly buyer (+ noise) exceeds 0.6."""
    score = churn_score(days, is_yearly)
    if noise_key:
        score = score + gaussian(noise_key, seed, 0.0, 0.1)
    return (score > 0.6).cast("int")


def calculated_clv(transactions: str | Column, value: str | Column) -> Column:
    return as_col(transactions) * as_col(value)


def form_values(df: DataFrame) -> DataFrame:
    """Total spent, in-store purchases and average purchase of an input form."""
    spent = F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_applied"))
    return df.withColumns(
        {
            "total_spent": spent,
            "in_store": F.col("num_purchases") - F.col("online_purchases"),
            "avg_purchase": spent / at_least_one("num_purchases"),
        }
    )


def map_request_fields(df: DataFrame) -> DataFrame:
    """Numeric request fields plus the model features that are aliases of them."""
    numeric = [F.col(c).cast("double").alias(c) for c in NUMERIC_REQUEST_FIELDS if has(df, c)]
    taken = {c for c in NUMERIC_REQUEST_FIELDS if has(df, c)}
    aliases = [F.col(s).cast("double").alias(d) for d, s in REQUEST_ALIASES.items() if has(df, s) and d not in taken]
    replaced = taken | {d for d, s in REQUEST_ALIASES.items() if has(df, s)}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in replaced]
    return df.select(*rest, *numeric, *aliases)


def apply_defaults(
    df: DataFrame, defaults: Mapping[str, float] = FEATURE_DEFAULTS, null_only: bool = False
) -> DataFrame:
    """Replace missing (and, unless ``null_only``, zero) values by defaults."""
    changed = {}
    for name, value in defaults.items():
        if has(df, name):
            c = F.col(name).cast("double")
            missing = c.isNull() if null_only else F.coalesce(c, F.lit(0.0)) == 0
            changed[name] = F.when(missing, F.lit(float(value))).otherwise(c)
    return df.withColumns(changed) if changed else df


def request_features(df: DataFrame, expected: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Requests -> model features: aliases, derived values, dummies, defaults, alignment."""
    from .encoders import income_bracket, purchase_frequency, request_dummies
    from .projection import align_features

    out = request_dummies(df, expected)
    if has(df, "income"):
        level = income_bracket("income")
        out = out.withColumns({f"income_bracket_{v}": flag(level == v) for v in ("Low", "Medium")})
    if has(df, "num_purchases"):
        level = purchase_frequency("num_purchases")
        out = out.withColumns(
            {f"purchase_frequency_{v}": flag(level == v) for v in ("Weekly", "Monthly", "Yearly")}
        )
    derived = {
        "engagement_score": engagement_serving(df),
        "recency_ratio": recency_ratio(df),
        "online_preference": engagement_ratio(df),
        "engagement_ratio": engagement_ratio(df),
        "quantity_times_price": quantity_times_price(df, discounted=True),
        "value_per_transaction": value_per_transaction(df),
    }
    if has(df, "days_since_last_purchase"):
        derived["recency_score"] = recency_score("days_since_last_purchase")
    out = map_request_fields(out.withColumns(derived))
    numeric = {f.name for f in out.schema.fields if isinstance(f.dataType, T.NumericType)}
    keys = [c for c in ("request_id", "customer_id") if has(df, c)]
    out = align_features(out.select(*[c for c in out.columns if c in numeric or c in keys]), expected, keys)
    return apply_defaults(out, {k: v for k, v in FEATURE_DEFAULTS.items() if k in expected})
