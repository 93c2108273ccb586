"""Catalogue: wide encodings, scoring with a model in the rule's place, display texts, the model catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..learning import scoring
from ..operators.encoders import level_table, one_hot_sparse
from ..session import Stages
from ..sources import model_store
from . import tables
from .model_queries import _fitted, _line_scores
from .oracle_base import with_
from .shared import rounded

WIDE = ["p_name", "p_type", "p_brand"]


def _one_hot(spark, d):
    """Places of the ones in a dummy vector over names, types and brands of parts."""
    rows = one_hot_sparse(tables.load(spark, d, "part").select("p_partkey", *WIDE), WIDE, Stages(spark))
    return rows.select("p_partkey", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def _levels(spark, d):
    """What each place of that vector stands for."""
    return level_table(tables.load(spark, d, "part"), WIDE, Stages(spark))


def _churn(spark, d):
    """Churn probability of the hold-out customers by the first model of the fixed order that there is."""
    model, _, test = _fitted("logistic_regression_classification", spark, d)
    return rounded(scoring.churn_scored(test, {"logistic_regression_classification": model}).select("customer_id", "churn_probability"))


def _texts(spark, d):
    """Balances as money and per mille of 1000 as a percentage, and a column name as a title."""
    rows = tables.load(spark, d, "supplier")
    share = F.round("s_acctbal") / 1000.0
    return rows.select(
        "s_suppkey", text.money_text("s_acctbal").alias("money"), text.percent_text(share).alias("percent"),
        text.title_text(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("_")))).alias("title"),
        numeric.relu("s_acctbal").alias("above_zero"),
    )


#: Endings of stored models, by nation number modulo their count.
ENDINGS = ["_classification_latest.pkl", "_regression.pkl", "_sklearn_random_forest_latest.pkl", "_sklearn_xgboost.pkl", ".pkl"]


def _catalogue(spark, d):
    """Model files named after nations, with the task that their names tell."""
    ending = F.array(*[F.lit(e) for e in ENDINGS])[(F.col("n_nationkey") % len(ENDINGS)).cast("int")]
    names = tables.load(spark, d, "nation").select(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), ending).alias("name"))
    return model_store.catalogue(names)


QUERIES = {
    "one_hot_sparse": _one_hot,
    "one_hot_levels": _levels,
    "churn_scored": _churn,
    "display_texts": _texts,
    "model_catalogue": _catalogue,
}

_LEVELS = (
    "lv AS (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS c, {c} AS level FROM part WHERE {c} IS NOT NULL" for i, c in enumerate(WIDE)) + ")"
    ", nm AS (SELECT c, level, row_number() OVER (ORDER BY c, level) - 1 AS pos, row_number() OVER (PARTITION BY c ORDER BY level) AS k, "
    "dense_rank() OVER (ORDER BY c) AS dropped FROM lv), ix AS (SELECT c, level, pos - dropped AS i FROM nm WHERE k > 1)"
)
_ENDING = "['" + "', '".join(ENDINGS) + "'][n_nationkey % " + str(len(ENDINGS)) + " + 1]"

ORACLES = {
    "one_hot_sparse": with_(
        _LEVELS,
        "SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"(SELECT i FROM ix WHERE c = {i} AND level = {c})" for i, c in enumerate(WIDE))
        + "], lambda x: x IS NOT NULL), ',') AS indices FROM part",
    ),
    "one_hot_levels": with_(_LEVELS, "SELECT c::integer AS \"column\", level, i AS \"index\" FROM ix"),
    "churn_scored": f"SELECT customer_id, probability AS churn_probability FROM ({_line_scores('logistic')})",
    "display_texts": """
SELECT s_suppkey, '$' || format('{:,.2f}', s_acctbal) AS money, format('{:,.1f}', ROUND(s_acctbal) / 10) || '%' AS percent,
  'Supplier ' || substr(s_name, 10) AS title, greatest(s_acctbal, 0) AS above_zero FROM supplier""",
    "model_catalogue": f"""
WITH f AS (SELECT lower(replace(n_name, ' ', '_')) AS base, {_ENDING} AS e FROM nation)
SELECT base || replace(replace(e, '.pkl', ''), '_latest', '') AS model,
  unnest(CASE WHEN e LIKE '\\_classification%' ESCAPE '\\' THEN ['classification'] WHEN e LIKE '\\_regression%' ESCAPE '\\' THEN ['regression']
    WHEN e LIKE '%forest%' THEN ['classification'] WHEN e LIKE '%xgboost%' THEN ['regression'] ELSE ['classification', 'regression'] END) AS task FROM f""",
}
