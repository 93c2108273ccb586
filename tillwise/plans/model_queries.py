"""Catalogue: training, scoring and explaining models on the customer table."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..learning import boosting, descent, evaluate, explain, gradient, scoring, trees
from ..learning.prep import training_table
from ..learning.registry import FAMILIES, families
from ..operators.scaling import mean_impute
from ..operators import whatif
from ..operators.sampling import split
from ..session import materialize, shared_folder
from ..sources import model_store
from . import tables, training_sql as sql
from .oracle_base import C360, with_
from .shared import rounded

FEATURES = [
    "quantity", "unit_price", "discount_applied", "total_transactions", "num_purchases", "membership_years",
    "website_visits", "online_purchases", "customer_support_calls", "product_return_rate", "acct_balance",
    "days_since_last_purchase", "email_subscriptions",
]
TWO = ["quantity", "unit_price"]
SQL_FEATURES = ["quantity", "unit_price", "num_purchases", "total_transactions", "days_since_last_purchase"]


def train_test(spark: SparkSession, d: str, task: str) -> tuple[DataFrame, DataFrame]:
    label = "churned" if task == "classification" else "total_sales"
    table = training_table(tables.customers(spark, d), FEATURES, label, keep=["customer_id"])
    return split(table, "customer_id", 0.2)


def _score_values(name: str):
    """Prediction, and for classifiers text and probability, of every test customer."""

    def run(spark, d):
        model, _, test = _fitted(name, spark, d)
        return scoring.score(model, test, ["customer_id", "label"], FAMILIES[name].task)

    return run


def _score(name: str):
    def run(spark, d):
        scored = _score_values(name)(spark, d)
        return rounded(scored if name in EXACT else _checked(scored, FAMILIES[name].task))

    return run


#: Families whose training SQL can repeat, so that it can give their predictions.
EXACT = (
    "linear_regression", "multiple_regression", "logistic_regression_classification", "svm_classification",
    "decision_tree_classification", "random_forest_classification", "random_forest_large_classification",
)


def _checked(scored: DataFrame, task: str) -> DataFrame:
    """Scores of a family that depends on the solver, with what must hold for every sound model of it.

    A classifier names a class, texts follow it, probabilities are probabilities,
    and it finds churners (F1 above the majority rule's 0). A regressor is finite
    and errs less than the mean does.
    """
    stored = materialize(scored, "scored")
    p, y = F.col("prediction"), F.col("label")
    if task == "regression":
        fit = stored.agg((F.sum((p - y) * (p - y)) < F.var_pop("label") * F.count("*")).alias("better")).scalar()
        sound = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
        return stored.select("customer_id", "label", sound.alias("finite"), fit.alias("beats_mean"))
    fit = stored.agg((F.count_if((p == 1) & (y == 1)) > 0).alias("better")).scalar()
    text = F.when(p == 1, "Churn").otherwise("Retain")
    return stored.select(
        "customer_id", "label", p.isin(0, 1).alias("is_class"), (F.col("label_text") == text).alias("text_follows"),
        F.col("probability").between(0.0, 1.0).alias("is_probability"), fit.alias("beats_majority"),
    )


def _fitted(name: str, spark, d):
    train, test = train_test(spark, d, FAMILIES[name].task)
    return FAMILIES[name].fit(train, FEATURES, "customer_id"), train, test


def _importance(spark, d):
    """Importance and rank of every feature in the forest."""
    model, _, _ = _fitted("random_forest_classification", spark, d)
    return rounded(explain.importance(spark, model, FEATURES), 6)


def _weights(spark, d):
    """Absolute weights of the one-feature descent model, ranked."""
    return rounded(explain.importance(spark, _simple(spark, d), SQL_FEATURES), 4)


def _usage(spark, d):
    """Split count of every feature the tree uses."""
    return explain.tree_usage(spark, _fitted("decision_tree_classification", spark, d)[0])


def _saved(spark, d):
    """Scores of a model that went through the model store."""
    model, _, test = _fitted("logistic_regression_classification", spark, d)
    path = os.path.join(shared_folder(spark), f"models-{uuid.uuid4().hex}")
    model_store.save(spark, model, f"{path}/logistic_latest.pkl", FEATURES)
    again, _ = model_store.load_named(spark, path, "logistic")
    return rounded(scoring.score(again, test, ["customer_id", "label"]))


def _attributions(spark, d):
    table = tables.customers(spark, d).select("customer_id", *SQL_FEATURES, "total_sales")
    model = descent.fit_multiple(table, SQL_FEATURES, "total_sales")
    return rounded(explain.linear_attributions(table, dict(zip(model.features, model.weights)), ["customer_id"]), 3)


def _loss(spark, d):
    table = tables.customers(spark, d).select(*SQL_FEATURES, "total_sales")
    return rounded(explain.loss_history(spark, descent.fit_multiple(table, SQL_FEATURES, "total_sales")), 6)


def _simple(spark, d):
    return descent.fit_simple(_linear_base(spark, d), SQL_FEATURES, "total_sales")


def _simple_attributions(spark, d):
    model = _simple(spark, d)
    base = tables.customers(spark, d).select("customer_id", *SQL_FEATURES)
    return explain.linear_attributions(base, dict(zip(model.features, model.weights)), ["customer_id"])


def _simple_results(spark, d):
    """Metrics of the one-feature descent model on all customers."""
    scored = _simple(spark, d).transform(_linear_base(spark, d)).withColumn("model", F.lit("linear"))
    return evaluate.regression_results(scored.withColumnRenamed("total_sales", "label"))


def _evaluate_values(task):
    """All families of a task, trained and evaluated: metrics and status of each."""

    def run(spark, d):
        train, test = train_test(spark, d, task)
        models, failures = evaluate.train_all(train, FEATURES, "customer_id", families(task))
        long = evaluate.predictions(models, test, "customer_id")
        results = evaluate.classification_results if task == "classification" else evaluate.regression_results
        return evaluate.with_failures(results(long), failures)

    return run


def _evaluate(task):
    """What holds for the figures of every sound model, put beside SQL's."""

    def run(spark, d):
        rows = _evaluate_values(task)(spark, d)
        if task == "classification":
            m = F.col("confusion_matrix")
            tested, right = m["TN"] + m["FP"] + m["FN"] + m["TP"], m["TN"] + m["TP"]
            return rows.select(
                "model", "status", tested.alias("tested"), (m["TP"] + m["FN"]).alias("churners"),
                (F.abs(F.col("accuracy") - right / tested) < 1e-9).alias("accuracy_agrees"),
                F.col("f1_score").between(0.0, 1.0).alias("is_share"),
            )
        return rows.select("model", "status", (F.col("mae") <= F.col("rmse")).alias("mae_below_rmse"), (F.col("r2") < 1).alias("r2_below_1"))

    return run


def _impacts(spark, d, moved: list[str], features: list[str]):
    """Impacts per test customer and moved feature, of the closed-form model on ``features``."""
    train, test = train_test(spark, d, "regression")
    model = FAMILIES["least_squares_regression"].fit(train, features, "customer_id")
    return whatif.model_impacts(test, moved, model, "customer_id", F.col("prediction"))


def _what_if_values(spark, d):
    return _impacts(spark, d, ["quantity", "unit_price", "discount_applied"], FEATURES)


def _what_if_model(spark, d):
    rows = _what_if_values(spark, d)
    most, mean = F.col("max_impact"), F.col("avg_impact")
    # a row without the feature, or a mean above the largest change by more than rounding, would be a fault
    sound = (mean >= 0) & (mean <= most + 1e-6) & (F.col("sensitivity") <= most + 1e-6)
    return rows.select("customer_id", "feature", F.coalesce(sound, F.lit(False)).alias("in_order"))


def _linear_base(spark, d):
    return tables.customers(spark, d).select(*SQL_FEATURES, "total_sales", "churned")


def _least_squares(spark, d):
    """Coefficients on two features, in the row form of a model table."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    base = mean_impute(_linear_base(spark, d), [*SQL_FEATURES, "total_sales"])
    x = ["quantity", "unit_price"]
    model = LinearRegression(solver="normal", labelCol="total_sales").fit(
        VectorAssembler(inputCols=x, outputCol="features").transform(base)
    )
    rows = [("intercept", float(model.intercept))] + [(f, float(c)) for f, c in zip(x, model.coefficients)]
    return spark.createDataFrame(rows, "term string, coefficient double")


#: The models' own values. They depend on the solver, so they have no SQL text; tests compare them with brute force.
VALUES = {
    **{f"score_{f.name}_values": _score_values(f.name) for f in families() if f.name not in EXACT},
    "what_if_model_values": _what_if_values,
    "evaluate_classification_values": _evaluate_values("classification"),
    "evaluate_regression_values": _evaluate_values("regression"),
}

QUERIES = {
    **VALUES,
    "what_if_two_features": lambda spark, d: rounded(_impacts(spark, d, TWO, TWO), 3),
    "gd_linear_exact": lambda spark, d: rounded(
        descent.simple_descent(_linear_base(spark, d), SQL_FEATURES, "total_sales"), 4
    ),
    "ols_small": lambda spark, d: rounded(_least_squares(spark, d), 3),
    "stump_round": lambda spark, d: rounded(
        boosting.first_round(mean_impute(_linear_base(spark, d), SQL_FEATURES), SQL_FEATURES, "churned"), 6, threshold=4
    ),
    **{f"score_{f.name}": _score(f.name) for f in families()},
    "feature_importance": _importance,
    "weight_importance": _weights,
    "tree_usage": _usage,
    "linear_attribution": _attributions,
    "simple_attribution": lambda spark, d: rounded(_simple_attributions(spark, d)),
    "simple_loss": lambda spark, d: rounded(explain.loss_history(spark, _simple(spark, d)), 6),
    "simple_results": lambda spark, d: rounded(_simple_results(spark, d)),
    "loss_history": _loss,
    "saved_models": _saved,
    "what_if_model": _what_if_model,
    "evaluate_classification": _evaluate("classification"),
    "evaluate_regression": _evaluate("regression"),
}

_COMPLETE = C360 + ", x AS (SELECT " + ", ".join(SQL_FEATURES) + ", total_sales, churned FROM c360 WHERE " + " AND ".join(
    f"{f} IS NOT NULL" for f in SQL_FEATURES
) + ")"

_SIMPLE = (
    C360
    + ", r AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr({f}, total_sales) AS r, avg({f}) AS m, stddev_pop({f}) AS s, "
        f"(SELECT avg(total_sales) FROM c360) AS my, (SELECT stddev_pop(total_sales) FROM c360) AS sy FROM c360"
        for f in SQL_FEATURES
    )
    + "), b AS (SELECT *, r * (1 - 0.998::double ^ 150) * sy / s AS w FROM r ORDER BY abs(r) DESC LIMIT 1), "
    + "v AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, customer_id, {f}::double AS x, total_sales AS y FROM c360" for f in SQL_FEATURES
    )
    + "), chosen AS (SELECT v.*, w, m, my, coalesce(x, m) * w + my - w * m AS pred FROM v JOIN b ON b.feature = v.feature)"
)

_TEST = "('0x' || substr(md5(customer_id::varchar || '|42'), 1, 8))::bigint % 10000 < 2000"


def _descent(fs: list[str], target: str, base: str) -> str:
    """Tables m (means), c (correlations and spreads) and w (weights by step) of the exact descent on ``base``."""
    safe = lambda a, b: f"CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END"
    k = range(len(fs))
    lr = f"{2 * descent.MULTIPLE['lr']!r}::double"
    step = ", ".join(f"w{i} - {lr} * (" + " + ".join(f"c{i}_{j} * w{j}" for j in k) + f" - r{i})" for i in k)
    return f"""
, m AS (SELECT {', '.join(f'avg({f}) AS m{i}' for i, f in enumerate(fs))} FROM {base})
, fl AS (SELECT {', '.join(f'coalesce({f}, m{i})::double AS x{i}' for i, f in enumerate(fs))}, {target}::double AS y FROM {base}, m)
, c AS (SELECT {', '.join(f'{safe(f"x{i}", f"x{j}")} AS c{i}_{j}' for i in k for j in k)},
  {', '.join(f'{safe(f"x{i}", "y")} AS r{i}, stddev_pop(x{i}) AS s{i}' for i in k)}, avg(y) AS my, stddev_pop(y) AS sy FROM fl)
, w AS (SELECT 0 AS t, {', '.join(f'0.0::double AS w{i}' for i in k)}
  UNION ALL SELECT t + 1, {step} FROM w, c WHERE t < {descent.MULTIPLE['epochs']})
, b AS (SELECT {', '.join(f'CASE WHEN s{i} = 0 THEN sy * w{i} ELSE sy * w{i} / s{i} END AS b{i}' for i in k)}, my
  FROM w, c WHERE t = {descent.MULTIPLE['epochs']})"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


#: Impacts of the least squares on two features: a weight times the move, which the observed range may cut short.
_TWO_IMPACTS = (
    C360
    + f""", m AS (SELECT avg(quantity) AS ma, avg(unit_price) AS mb FROM c360 WHERE NOT ({_TEST}))
, x AS (SELECT coalesce(quantity, ma)::double AS a, coalesce(unit_price, mb)::double AS b, total_sales AS y FROM c360, m WHERE NOT ({_TEST}))
, c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bs FROM x)
, k AS (SELECT (ay * bb - bs * ab) / (aa * bb - ab * ab) AS wa, (bs * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c)
, v AS ("""
    + " UNION ALL ".join(
        f"SELECT customer_id, '{f}' AS feature, {f}::double AS x, {w} AS w, stddev_samp({f}) OVER () AS s, "
        f"min({f}) OVER ()::double AS lo, max({f}) OVER ()::double AS hi FROM c360, k WHERE {_TEST}"
        for f, w in (("quantity", "wa"), ("unit_price", "wb"))
    )
    + "), i AS (SELECT customer_id, feature, "
    + "list_transform([greatest(x - 2 * s, lo), greatest(x - s, lo), least(x + s, hi), least(x + 2 * s, hi)], "
    + "lambda z: coalesce(abs(w * (z - x)), 0.0::double)) AS i FROM v)"
)

_KNOWN = C360 + sql.filled(FEATURES, "churned", f"NOT ({_TEST})")
_TREES = {"decision_tree_classification": 0, "random_forest_classification": 50, "random_forest_large_classification": 200}
_RULES = {n: trees.Rule(take=math.isqrt(len(FEATURES)) if n in _TREES and _TREES[n] else None) for n in _TREES}
#: Tables of the grown trees, by family.
_GROWN = {
    n: _KNOWN + (sql.copies(k, _RULES[n].seed) if k else "") + sql.tree_nodes(len(FEATURES), _RULES[n], k > 0) for n, k in _TREES.items()
}


def _named(prediction: str, probability: str, tables: str) -> str:
    return (
        f"SELECT customer_id, y::double AS label, ({prediction})::integer AS prediction, CASE WHEN {prediction} THEN 'Churn' ELSE 'Retain' END AS label_text, "
        f"round({probability}, 4) AS probability FROM {tables}"
    )


def _line_scores(loss: str) -> str:
    """Hold-out scores after all steps of a line model."""
    steps = gradient.LOGISTIC["epochs"] if loss == "logistic" else gradient.HINGE["epochs"]
    g = sql.margin(len(FEATURES))
    p = f"1 / (1 + exp(-least(greatest({g}, -30), 30)))"
    pick = _named(f"{p} >= 0.5", p, f"z, w WHERE t = {steps} AND NOT tr") if loss == "logistic" else _named(f"{g} >= 0", "0.5::double", f"z, w WHERE t = {steps} AND NOT tr")
    return _recursive(with_(_KNOWN + sql.line(len(FEATURES), loss, steps), pick))


def _tree_scores(family: str) -> str:
    """Hold-out scores of a family of trees; a single tree has no probability."""
    tables = f"fl JOIN ({sql.votes()}) USING (customer_id)"
    return with_(_GROWN[family], _named("p >= 0.5", "p" if _TREES[family] else "0.5::double", tables))


_N = range(len(SQL_FEATURES))
_CHECKS = {
    "classification": ("churned", "TRUE AS is_class, TRUE AS text_follows, TRUE AS is_probability, TRUE AS beats_majority"),
    "regression": ("total_sales", "TRUE AS finite, TRUE AS beats_mean"),
}

ORACLES = {
    **{
        f"score_{f.name}": with_(
            C360,
            f"SELECT customer_id, round({_CHECKS[f.task][0]}::double, 4) AS label, {_CHECKS[f.task][1]} FROM c360 WHERE {_TEST}",
        )
        for f in families()
        if f.name not in EXACT
    },
    "score_multiple_regression": _recursive(
        with_(
            C360 + f", s AS (SELECT * FROM c360 WHERE NOT ({_TEST}))" + _descent(FEATURES, "total_sales", "s"),
            "SELECT customer_id, round(total_sales, 4) AS label, round(my + "
            + " + ".join(f"b{i} * (coalesce({f}, m{i}) - m{i})" for i, f in enumerate(FEATURES))
            + f", 4) AS prediction FROM c360, m, b WHERE {_TEST}",
        )
    ),
    "loss_history": _recursive(
        with_(
            C360 + _descent(SQL_FEATURES, "total_sales", "c360"),
            "SELECT t::integer AS epoch, round(1 - 2 * ("
            + " + ".join(f"w{i} * r{i}" for i in _N) + ") + "
            + " + ".join(f"c{i}_{j} * w{i} * w{j}" for i in _N for j in _N)
            + f", 6) AS loss FROM w, c WHERE t < {descent.MULTIPLE['epochs']}",
        )
    ),
    "linear_attribution": _recursive(
        with_(
            C360 + _descent(SQL_FEATURES, "total_sales", "c360"),
            " UNION ALL ".join(
                f"SELECT customer_id, '{f}' AS feature, round({f}::double, 3) AS value, "
                f"round(b{i} * (coalesce({f}, m{i}) - m{i}), 3) AS contribution, "
                f"CASE WHEN b{i} * (coalesce({f}, m{i}) - m{i}) > 0 THEN 'positive' ELSE 'negative' END AS impact FROM c360, m, b"
                for i, f in enumerate(SQL_FEATURES)
            ),
        )
    ),
    "weight_importance": with_(
        _SIMPLE,
        "SELECT r.feature, round(CASE WHEN r.feature = b.feature THEN abs(b.w) ELSE 0.0::double END, 4) AS importance, "
        "(row_number() OVER (ORDER BY r.feature <> b.feature, r.feature))::integer AS rank FROM r, b",
    ),
    "tree_usage": with_(
        _GROWN["decision_tree_classification"], f"SELECT ({FEATURES!r})[f + 1] AS feature, count(*) AS splits FROM nodes WHERE f IS NOT NULL GROUP BY 1"
    ),
    "saved_models": _line_scores("logistic"),
    "score_logistic_regression_classification": _line_scores("logistic"),
    "score_svm_classification": _line_scores("hinge"),
    "score_decision_tree_classification": _tree_scores("decision_tree_classification"),
    "score_random_forest_classification": _tree_scores("random_forest_classification"),
    "score_random_forest_large_classification": _tree_scores("random_forest_large_classification"),
    "what_if_model": with_(
        C360,
        "SELECT customer_id, unnest(['quantity', 'unit_price', 'discount_applied']) AS feature, "
        f"TRUE AS in_order FROM c360 WHERE {_TEST}",
    ),
    "what_if_two_features": with_(
        _TWO_IMPACTS,
        "SELECT customer_id, feature, round(list_max(i), 3) AS max_impact, round(list_avg(i), 3) AS avg_impact, "
        "round(list_max(i) - list_min(i), 3) AS sensitivity FROM i",
    ),
    "feature_importance": with_(
        _GROWN["random_forest_classification"],
        f"""
, gn AS (SELECT tree, f, sum((gini - score) * n) AS g FROM nodes WHERE f IS NOT NULL GROUP BY 1, 2)
, im AS (SELECT f, sum(g / t) / {_TREES["random_forest_classification"]} AS i FROM gn JOIN (SELECT tree, sum(g) AS t FROM gn GROUP BY 1) USING (tree) GROUP BY f)
SELECT ({FEATURES!r})[k + 1] AS feature, round(coalesce(i, 0), 6) AS importance,
  (row_number() OVER (ORDER BY coalesce(i, 0) DESC, ({FEATURES!r})[k + 1]))::integer AS rank FROM (SELECT unnest(range({len(FEATURES)})) AS k) LEFT JOIN im ON f = k""",
    ),
    "evaluate_classification": with_(
        C360,
        "SELECT unnest(" + repr([f.title for f in families("classification")]) + ") AS model, 'OK' AS status, "
        "count(*) AS tested, count(*) FILTER (churned = 1) AS churners, TRUE AS accuracy_agrees, TRUE AS is_share "
        f"FROM c360 WHERE {_TEST}",
    ),
    "evaluate_regression": "SELECT unnest(" + repr([f.title for f in families("regression")]) + ") AS model, "
    "'OK' AS status, TRUE AS mae_below_rmse, TRUE AS r2_below_1",
    "gd_linear_exact": with_(
        _SIMPLE,
        "SELECT feature, round(r, 4) AS correlation, round(w, 4) AS weight, round(my - w * m, 4) AS bias FROM b",
    ),
    "simple_attribution": with_(
        _SIMPLE,
        "SELECT customer_id, feature, round(x, 4) AS value, round(w * (coalesce(x, m) - m), 4) AS contribution, "
        "CASE WHEN w * (coalesce(x, m) - m) > 0 THEN 'positive' ELSE 'negative' END AS impact FROM chosen",
    ),
    "simple_loss": with_(
        _SIMPLE,
        "SELECT i::integer AS epoch, round(1 - r * r + r * r * 0.998::double ^ (2 * i), 6) AS loss FROM b, range(150) t(i)",
    ),
    "simple_results": with_(
        _SIMPLE,
        "SELECT 'linear' AS model, round(sqrt(avg((y - pred) ^ 2)), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae, "
        "round(1 - sum((y - pred) ^ 2) / (var_pop(y) * count(*)), 4) AS r2, "
        "round(avg(abs((y - pred) / y)) FILTER (y > 0) * 100, 4) AS mape, 'OK' AS status FROM chosen",
    ),
    "score_linear_regression": with_(
        C360,
        """, s AS (
  SELECT *, ('0x' || substr(md5(customer_id::varchar || '|42'), 1, 8))::bigint % 10000 < 2000 AS is_test FROM c360
), r AS ("""
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, corr({f}, total_sales) AS r, avg({f}) AS m, stddev_pop({f}) AS s, "
            "avg(total_sales) AS my, stddev_pop(total_sales) AS sy FROM s WHERE NOT is_test"
            for f in FEATURES
        )
        + "), b AS (SELECT *, r * (1 - 0.998::double ^ 150) * sy / s AS w FROM r ORDER BY abs(r) DESC LIMIT 1), v AS ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, customer_id, {f}::double AS x, total_sales AS y FROM s WHERE is_test" for f in FEATURES
        )
        + ") SELECT customer_id, round(y, 4) AS label, round(coalesce(x, m) * w + my - w * m, 4) AS prediction "
        "FROM v JOIN b ON b.feature = v.feature",
    ),
    "ols_small": with_(
        _COMPLETE,
        """, c AS (
  SELECT var_pop(quantity) AS aa, var_pop(unit_price) AS bb, covar_pop(quantity, unit_price) AS ab,
         covar_pop(quantity, total_sales) AS ay, covar_pop(unit_price, total_sales) AS bs,
         avg(quantity) AS ma, avg(unit_price) AS mb, avg(total_sales) AS my FROM x
), k AS (SELECT *, (ay * bb - bs * ab) / (aa * bb - ab * ab) AS wa, (bs * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c)
SELECT 'quantity' AS term, round(wa, 3) AS coefficient FROM k
UNION ALL SELECT 'unit_price', round(wb, 3) FROM k
UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 3) FROM k""",
    ),
    "stump_round": with_(
        _COMPLETE,
        ", n AS (SELECT count(*) FILTER (churned = 1) AS p, count(*) FILTER (churned = 0) AS q FROM x), "
        "l AS ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {f}::double AS v, churned, "
            "CASE WHEN churned = 1 THEN 0.5::double / p ELSE 0.5::double / q END AS w FROM x, n"
            for f in SQL_FEATURES
        )
        + "), c AS (SELECT DISTINCT feature, t FROM ("
        + " UNION ALL ".join(
            f"SELECT feature, quantile_cont(v, {q}) AS t FROM l GROUP BY 1" for q in boosting.CUTS
        )
        + ")), e AS (SELECT l.feature, t, sum(CASE WHEN (v >= t) <> (churned = 1) THEN w ELSE 0 END) AS e, "
        "sum(w) AS total FROM l JOIN c ON l.feature = c.feature GROUP BY 1, 2) "
        "SELECT feature, round(t, 4) AS threshold, 1 AS polarity, round(e, 6) AS error FROM e "
        "UNION ALL SELECT feature, round(t, 4), -1, round(total - e, 6) FROM e",
    ),
}
