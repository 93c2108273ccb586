"""Categorical encodings: one-hot, value maps, threshold levels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numeric import as_col, flag
from ..session import Stages, materialize

# Categorical columns of the training table.
TRAINING_CATEGORICALS = [
    "gender", "income_bracket", "marital_status", "education_level", "occupation",
    "product_category", "payment_method", "store_location", "day_of_week",
    "purchase_frequency", "preferred_store", "product_name", "product_brand",
    "product_size", "product_color", "product_material", "promotion_type",
    "promotion_effectiveness", "promotion_channel", "promotion_target_audience",
    "customer_city", "customer_state", "store_city", "store_state", "season",
    "app_usage", "social_media_engagement",
]
# Categorical columns encoded when a whole table is scored.
SERVING_CATEGORICALS = [
    "gender", "store_location", "customer_city", "store_city", "app_usage_frequency",
    "social_media_engagement", "education_level", "marital_status", "product_category",
    "payment_method", "income_level",
]
# Yes/No columns.
YES_NO_COLUMNS = ["loyalty_program", "churned", "holiday_season", "weekend", "email_subscriptions"]
# Ternary codes.
GENDER_CODES = {"Male": 1, "Female": 0, "Other": 2}
MARITAL_CODES = {"Married": 1, "Single": 0, "Divorced": 2}
# Request columns that set dummies, with the prefix of their dummies' names.
DUMMY_PREFIXES = {
    "gender": "gender_",
    "store_location": "store_location_",
    "customer_city": "customer_city_",
    "store_city": "store_city_",
    "app_usage_frequency": "app_usage_",
    "social_media_engagement": "social_media_engagement_",
    "education_level": "education_level_",
    "marital_status": "marital_status_",
    "product_category": "product_category_",
    "payment_method": "payment_method_",
}
# Levels that may set a dummy, where not every level does.
KNOWN_LEVELS = {
    "gender": ["Male", "Other"],
    "app_usage_frequency": ["Low", "Medium"],
    "social_media_engagement": ["Low", "Medium"],
    "education_level": ["High School", "Bachelor", "Master", "PhD"],
    "marital_status": ["Married", "Single", "Divorced"],
}


def fit_levels(df: DataFrame, columns: Sequence[str], max_levels: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct levels of each column, found in one pass.

    All columns are unpivoted and reduced together, so one shuffle of distinct
    (column, level) pairs serves every column. A caller may name a number of
    levels beyond which a column is refused; for wide columns
    :func:`frequency_encode` gives one column whatever the number of levels.
    """
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "level"
    )
    pairs = long.where("level is not null").distinct()
    rows = (pairs if max_levels is None else pairs.limit(max_levels * len(columns) + 1)).collect()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        levels[row["column"]].append(row["level"])
    wide = [c for c in columns if max_levels is not None and len(levels[c]) > max_levels]
    if wide or (max_levels is not None and len(rows) > max_levels * len(columns)):
        raise ValueError(f"more than {max_levels} levels in {wide or list(columns)}")
    return {c: sorted(v) for c, v in levels.items()}


def one_hot(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]],
    drop_first: bool = True,
    keep_source: bool = False,
) -> DataFrame:
    """0/1 columns ``{column}_{level}``; null and unseen levels give all zeros."""
    dummies = []
    for column, values in levels.items():
        kept = list(values)[1:] if drop_first else list(values)
        dummies += [flag(F.col(column) == v).alias(f"{column}_{v}") for v in kept]
    rest = [c for c in df.columns if keep_source or c not in levels]
    return df.select(*[F.col(f"`{c}`") for c in rest], *dummies)


def request_dummies(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Add the dummies among ``expected`` that a present column can set; 0 for null and other levels.

    The expected names decide: behind a column's prefix stands the level that
    sets the dummy, so a level the model does not know sets nothing.
    """
    dummies = {}
    for column, prefix in DUMMY_PREFIXES.items():
        if column in df.columns:
            for name in expected:
                level = name.removeprefix(prefix)
                if name.startswith(prefix) and level in KNOWN_LEVELS.get(column, [level]) and name not in df.columns:
                    dummies[name] = flag(F.col(column) == level)
    return df.withColumns(dummies) if dummies else df


def binary_map(c: str | Column) -> Column:
    """Yes -> 1, No -> 0, anything else -> null."""
    c = as_col(c)
    return F.when(c == "Yes", F.lit(1)).when(c == "No", F.lit(0))


def map_yes_no(df: DataFrame, columns: Iterable[str] = YES_NO_COLUMNS) -> DataFrame:
    """Apply :func:`binary_map` to those listed columns that are present and textual."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: binary_map(c) for c in columns if c in text})


def code_map(c: str | Column, codes: Mapping[str, int]) -> Column:
    """Text to integer code; unlisted values give null."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.create_map(*pairs)[as_col(c)]


def level_by_threshold(value: str | Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First level whose lower bound the value reaches."""
    value = as_col(value)
    chain = None
    for bound, level in steps:
        chain = (F if chain is None else chain).when(value >= bound, F.lit(level))
    return chain.otherwise(F.lit(otherwise))


def income_bracket(income: str | Column) -> Column:
    """Below 30 000 Low, below 70 000 Medium, else High (the baseline level)."""
    return level_by_threshold(income, [(70000, "High"), (30000, "Medium")], "Low")


def purchase_frequency(purchases: str | Column) -> Column:
    return level_by_threshold(purchases, [(50, "Weekly"), (20, "Monthly")], "Yearly")


def ordinal_encode(c: str | Column, order: Sequence[str]) -> Column:
    """Position of a level in a given order, from 0."""
    return code_map(c, {v: i for i, v in enumerate(order)})


def frequency_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Share of rows holding each row's level.

    Levels are counted with map-side combine and written, so that their true size
    decides how they are joined back: few levels are broadcast, and a level that
    holds most rows never gathers its rows in one task.
    """
    counts = df.groupBy(F.col(column).alias("_level")).agg(F.count("*").alias("_n"))
    n = df.agg(F.count("*").alias("n")).scalar()
    shares = materialize(counts.select("_level", (F.col("_n") / n).alias(out)), "levels")
    return df.join(shares, F.col(column).eqNullSafe(F.col("_level")), "left").drop("_level")


def level_table(df: DataFrame, columns: Sequence[str], stages: Stages) -> DataFrame:
    """``column, level, index`` of every level but each column's first: its place in a vector over all columns.

    Levels are numbered in (column, level) order by range: no task sorts them all, and none reaches the driver.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for i, c in enumerate(columns)])
    levels = stages.keep(df.select(F.inline(pairs)).where("level IS NOT NULL").distinct(), "levels")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = levels.repartitionByRange(parts, "column", "level").sortWithinPartitions("column", "level")
    stored = stages.keep(ranged.withColumn("_place", F.monotonically_increasing_id()), "level-places")
    part = F.shiftrightunsigned("_place", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = counts.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = stored.withColumn("_part", part).join(starts, "_part")
    placed = placed.select("column", "level", (F.col("_before") + F.col("_place") - F.col("_first")).alias("pos"))
    placed = stages.keep(placed, "level-index")
    firsts = placed.groupBy("column").agg(F.min("pos").alias("_start"))  # a row per column
    dropped = F.row_number().over(Window.orderBy("column")).cast("long")
    firsts = firsts.withColumn("_dropped", dropped)
    kept = placed.join(firsts, "column").where("pos > _start")
    return stages.keep(kept.select("column", "level", (F.col("pos") - F.col("_dropped")).alias("index")), "level-table")


def one_hot_sparse(df: DataFrame, columns: Sequence[str], stages: Stages) -> DataFrame:
    """``df`` with ``indices``: ascending places of the ones in the dummy vector over all ``columns``.

    The first level of each column in alphabetical order has no place, and a null has none. For any number of
    levels: each column meets its levels in a join, broadcast or shuffled by their size.
    """
    table = level_table(df, columns, stages)
    out = df
    for i, c in enumerate(columns):
        mine = table.where(F.col("column") == i).select(F.col("level").alias(f"_level{i}"), F.col("index").alias(f"_index{i}"))
        out = out.join(mine, F.col(f"`{c}`").cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
    places = [F.col(f"_index{i}") for i in range(len(columns))]
    return out.withColumn("indices", F.array_compact(F.array(*places))).drop(*[f"_index{i}" for i in range(len(columns))])
