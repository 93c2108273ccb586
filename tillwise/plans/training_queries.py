"""Catalogue: the training algorithms themselves, step by step, with texts that recompute every step."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..learning import boosting, descent, gradient, regression_boosting, trees
from ..operators.batches import batch_numbers
from ..operators.bootstrap import bootstrap_counts, exact_bootstrap
from ..operators.sampling import BUCKETS
from ..session import Stages, shared_folder
from ..sources import model_store
from . import tables
from . import training_sql as sql
from .model_queries import FEATURES, SQL_FEATURES, _descent, _recursive
from .oracle_base import C360, with_
from .shared import rounded

STEPS = 5
COST_SQL = "CASE WHEN y = 1 THEN (SELECT (count(*) FILTER (y = 0))::double / count(*) FILTER (y = 1) FROM z) ELSE 1.0::double END"


def _base(spark, d, *more):
    return tables.customers(spark, d).select("customer_id", *SQL_FEATURES, *more)


def _steps(fit):
    """Weights after a few steps, taken in two runs."""

    def run(spark, d):
        base = _base(spark, d, "churned")
        first = fit(base, SQL_FEATURES, "churned", epochs=2)
        return rounded(fit(base, SQL_FEATURES, "churned", epochs=STEPS - 2, start=first).coefficients(spark), 8)

    return run


def _twice(spark, name, features, fit):
    """Train in two runs with the model store between them."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    model_store.resume(spark, path, features, fit)
    return model_store.resume(spark, path, features, fit)


def _warm_descent(spark, d):
    """Weights of 75 and 75 steps of the descent on all features."""
    base = _base(spark, d, "total_sales")
    fit = lambda start: descent.fit_multiple(base, SQL_FEATURES, "total_sales", epochs=75, start=start)
    model = _twice(spark, "warm-descent", SQL_FEATURES, fit)
    rows = [(f, w, model.steps) for f, w in zip([*model.features, "intercept"], [*model.weights, model.bias])]
    return rounded(spark.createDataFrame(rows, "term string, weight double, steps int"), 6)


STUMP_ROUNDS = 4
STUMP_LR = 0.5


def _warm_stumps(spark, d):
    """The stumps of two and two rounds."""
    base = _base(spark, d, "churned")

    def fit(start):
        return boosting.fit_stumps(base, SQL_FEATURES, "churned", "customer_id", rounds=STUMP_ROUNDS // 2, lr=STUMP_LR, start=start)

    model = _twice(spark, "warm-stumps", SQL_FEATURES, fit)
    rows = [(i + 1, s.feature, s.threshold, s.polarity, s.alpha) for i, s in enumerate(model.stumps)]
    return rounded(spark.createDataFrame(rows, "round int, feature string, threshold double, polarity int, alpha double"), 6, threshold=4)


def _tree(depth):
    """Every node of a tree on all customers, with its impurity and its split's."""

    def run(spark, d):
        table = tables.customers(spark, d).select(*FEATURES, "churned")
        return rounded(trees.fit_tree(table, FEATURES, "churned", trees.Rule(depth=depth)).rows(spark), 6, threshold=4)

    return run


SAMPLES = 6


def _forest(spark, d):
    """Every node of a small forest."""
    table = tables.customers(spark, d).select("customer_id", *FEATURES, "churned")
    model = trees.fit_forest(table, FEATURES, "customer_id", "churned", SAMPLES, trees.Rule(depth=2, take=3))
    return rounded(model.rows(spark), 6, threshold=4)


def _bootstrap(spark, d):
    """Copies of every customer in every sample that draws it."""
    return bootstrap_counts(tables.customers(spark, d).select("customer_id"), "customer_id", SAMPLES)


def _exact_bootstrap(spark, d):
    """Samples of exactly as many copies as there are customers."""
    return exact_bootstrap(tables.customers(spark, d).select("customer_id"), "customer_id", SAMPLES)


def _boosted(spark, d):
    """The tree of the first round, of depth 1, on all features."""
    table = tables.customers(spark, d).select(*FEATURES, "total_sales")
    model = regression_boosting.fit_boosted(table, FEATURES, "total_sales", rounds=1, depth=1, take=len(FEATURES))
    return rounded(model.rows(spark), 6, cut=4)


BATCH = 64


def _batches(spark, d):
    """The batch of every customer in two epochs, and the size of the batch."""
    keys, stages = tables.customers(spark, d).select("customer_id"), Stages(spark)
    out = None
    for epoch in (0, 1):
        rows = batch_numbers(keys, "customer_id", BATCH, stages, 42 + epoch)
        sizes = rows.groupBy("batch").agg(F.count("*").alias("size"))
        rows = rows.join(sizes, "batch").select("customer_id", F.lit(epoch).alias("epoch"), "batch", "pos", "size")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "boosted_round": _boosted,
    "mini_batches": _batches,
    "tree_depth_1": _tree(1),
    "tree_depth_2": _tree(2),
    "forest_small": _forest,
    "bootstrap_counts": _bootstrap,
    "exact_bootstrap": _exact_bootstrap,
    "logistic_steps": _steps(gradient.fit_logistic),
    "svm_steps": _steps(gradient.fit_hinge),
    "warm_start_descent": _warm_descent,
    "warm_start_stumps": _warm_stumps,
}

_K = range(len(SQL_FEATURES))

#: Table z: mean-filled and standardised features x0.. with the class y.
_Z = (
    C360
    + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(SQL_FEATURES)) + " FROM c360)"
    + ", fl AS (SELECT customer_id, churned::double AS y, " + ", ".join(f"coalesce({f}, m{i})::double AS v{i}" for i, f in enumerate(SQL_FEATURES))
    + " FROM c360, m)"
    + ", z AS MATERIALIZED (SELECT y, " + ", ".join(
        f"(v{i} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS x{i}" for i in _K
    ) + " FROM fl, m, (SELECT " + ", ".join(f"stddev_pop(v{i}) AS s{i}" for i in _K) + " FROM fl))"
)
_MARGIN = " + ".join(f"w{i} * x{i}" for i in _K) + " + b"


def _line_sql(pull: str, rate: str, penalty: str) -> str:
    """Weights after the steps, by recursion; ``pull`` is what a row at margin ``g`` adds, ``rate`` the step at step ``t``."""
    step = ", ".join(f"any_value(w{i}) - {rate} * (avg(({pull}) * x{i}) + {penalty} * any_value(w{i}))" for i in _K)
    text = _Z + f""", w AS (
  SELECT 0 AS t, {', '.join(f'0.0::double AS w{i}' for i in _K)}, 0.0::double AS b
  UNION ALL
  SELECT t + 1, {step}, any_value(b) - {rate} * avg({pull})
  FROM (SELECT *, {_MARGIN} AS g FROM w, zc WHERE t < {STEPS}) GROUP BY t
)"""
    text = text.replace(", w AS (", f", zc AS MATERIALIZED (SELECT *, {COST_SQL} AS c FROM z), w AS (", 1)
    out = " UNION ALL ".join(f"SELECT '{f}' AS term, round(w{i}, 8) AS weight FROM w WHERE t = {STEPS}" for i, f in enumerate(SQL_FEATURES))
    return _recursive(with_(text, out + f" UNION ALL SELECT 'intercept', round(b, 8) FROM w WHERE t = {STEPS}"))


def _stump_sql() -> str:
    """Boosting unrolled: cuts from the training rows, then a table of errors and one of weights per round."""
    train = f"('0x' || substr(md5(customer_id::varchar || '|42'), 1, 8))::bigint % {BUCKETS} >= {round(0.15 * BUCKETS)}"
    text = _Z.split(", z AS")[0] + f""", tr AS MATERIALIZED (SELECT * FROM fl WHERE {train})
, n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM tr)
, lg AS MATERIALIZED ({' UNION ALL '.join(f"SELECT customer_id, {i} AS f, v{i} AS v, y FROM tr" for i in _K)})
, cu AS MATERIALIZED (SELECT DISTINCT f, unnest(quantile_cont(v, {boosting.CUTS!r})) AS thr FROM lg GROUP BY f)
, w0 AS MATERIALIZED (SELECT customer_id, y, CASE WHEN y = 1 THEN 0.5::double / p ELSE 0.5::double / q END AS w FROM tr, n)"""
    for r in range(STUMP_ROUNDS):
        text += f"""
, e{r} AS (SELECT f, thr, sum(CASE WHEN (v >= thr) <> (lg.y = 1) THEN w ELSE 0 END) / sum(w) AS e FROM lg JOIN cu USING (f) JOIN w{r} USING (customer_id) GROUP BY 1, 2)
, o{r} AS (SELECT f, thr, 1 AS pol, e FROM e{r} UNION ALL SELECT f, thr, -1, 1 - e FROM e{r})
, k{r} AS MATERIALIZED (SELECT *, 0.5 * ln((1 - greatest(e, 1e-12)) / greatest(e, 1e-12)) * {STUMP_LR} AS a FROM o{r} ORDER BY round(e, 12), f, thr, pol DESC LIMIT 1)
, w{r + 1} AS MATERIALIZED (
  SELECT customer_id, lg.y, w * exp(-(2 * lg.y - 1) * a * pol * CASE WHEN v >= thr THEN 1 ELSE -1 END) AS w
  FROM w{r} JOIN lg USING (customer_id) JOIN k{r} USING (f))"""
    names = "['" + "', '".join(SQL_FEATURES) + "']"
    return with_(text, " UNION ALL ".join(
        f"SELECT {r + 1} AS round, ({names})[f + 1] AS feature, round(thr, 4) AS threshold, pol AS polarity, round(a, 6) AS alpha FROM k{r}"
        for r in range(STUMP_ROUNDS)
    ))


_ALL = C360 + sql.filled(FEATURES, "churned", "TRUE")
_SMALL = trees.Rule(depth=2, take=3)

ORACLES = {
    "boosted_round": with_(
        C360 + sql.filled(FEATURES, "total_sales", "TRUE", kind="double") + sql.boosted_round(FEATURES, regression_boosting.DISTINCT, regression_boosting.PERCENTILES),
        f"""SELECT 1 AS round, 1::bigint AS node, ({FEATURES!r})[f + 1] AS feature, round(cut, 4) AS cut, NULL::double AS value FROM bb
UNION ALL SELECT 1, 2, NULL, NULL, round(s / l, 6) FROM bb UNION ALL SELECT 1, 3, NULL, NULL, round((t - s) / (n - l), 6) FROM bb""",
    ),
    "mini_batches": with_(
        C360,
        f""", pp AS (SELECT customer_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY substr(md5(customer_id::varchar || '|' || (42 + epoch)), 1, 15)) - 1 AS pos
  FROM c360, (SELECT unnest([0, 1]) AS epoch))
SELECT customer_id, epoch, pos // {BATCH} AS batch, pos, count(*) OVER (PARTITION BY epoch, pos // {BATCH}) AS size FROM pp""",
    ),
    **{f"tree_depth_{k}": with_(_ALL + sql.tree_nodes(len(FEATURES), trees.Rule(depth=k), False), sql.node_rows(FEATURES)) for k in (1, 2)},
    "forest_small": with_(
        _ALL + sql.copies(SAMPLES, _SMALL.seed) + sql.tree_nodes(len(FEATURES), _SMALL, True), sql.node_rows(FEATURES)
    ),
    "bootstrap_counts": with_(_ALL + sql.copies(SAMPLES, 42), "SELECT customer_id, tree::integer AS tree, copies FROM dr WHERE copies > 0"),
    "exact_bootstrap": with_(
        _ALL,
        f""", ra AS (SELECT count(*) AS n, 1 + 10 / sqrt(count(*)) AS r FROM fl)
, ps AS (SELECT k, n, round(sum(exp(-r) * r ** k / factorial(k::integer)) OVER (ORDER BY k) * 4294967296)::bigint AS step FROM ra, (SELECT unnest(range(20)) AS k))
, mk AS (SELECT customer_id, tree, ('0x' || substr(md5(customer_id::varchar || '|' || tree || '|42'), 1, 8))::bigint AS mark FROM fl, (SELECT unnest(range({SAMPLES})) AS tree))
, cp AS (SELECT customer_id, tree, k + 1 AS copy, n FROM mk JOIN ps ON mark >= step)
, kept AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY tree ORDER BY substr(md5(customer_id::varchar || '|' || tree || '|' || copy || '|42'), 1, 15)) <= n)
SELECT tree::integer AS tree, customer_id, count(*) AS copies FROM kept GROUP BY 1, 2""",
    ),
    "logistic_steps": _line_sql("1 / (1 + exp(-least(greatest(g, -30), 30))) - y", f"{gradient.LOGISTIC['lr']!r}::double", "0"),
    "svm_steps": _line_sql(
        "CASE WHEN (2 * y - 1) * g < 1 THEN -c * (2 * y - 1) ELSE 0 END", f"({gradient.HINGE['lr']!r}::double / sqrt(t + 1))", "1"
    ),
    "warm_start_descent": _recursive(
        with_(
            C360 + _descent(SQL_FEATURES, "total_sales", "c360"),
            " UNION ALL ".join(f"SELECT '{f}' AS term, round(b{i}, 6) AS weight, 150 AS steps FROM b" for i, f in enumerate(SQL_FEATURES))
            + " UNION ALL SELECT 'intercept', round(my - (" + " + ".join(f"b{i} * m{i}" for i in _K) + "), 6), 150 FROM b, m",
        )
    ),
    "warm_start_stumps": _stump_sql(),
}
