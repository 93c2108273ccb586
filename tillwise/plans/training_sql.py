"""DuckDB texts of training: line models by recursion, trees unrolled level by level."""

from __future__ import annotations

from collections.abc import Sequence

from ..learning import gradient
from ..learning.trees import CUTS, Rule
from ..operators.bootstrap import poisson_steps

#: Hold-out rows of the split by key.
TEST = "('0x' || substr(md5(customer_id::varchar || '|42'), 1, 8))::bigint % 10000 < 2000"


def filled(features: Sequence[str], label: str, train: str, base: str = "c360", kind: str = "integer") -> str:
    """Tables m (means of the training rows), fl (customer_id, y, tr, xs: filled features) and fr (the same at nine digits, for trees)."""
    means = ", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(features))
    values = ", ".join(f"coalesce({f}, m{i})::double" for i, f in enumerate(features))
    return f"""
, m AS (SELECT {means} FROM {base} WHERE {train})
, fl AS MATERIALIZED (SELECT customer_id, {label}::{kind} AS y, {train} AS tr, [{values}] AS xs FROM {base}, m)
, fr AS MATERIALIZED (SELECT * REPLACE (list_transform(xs, lambda x: ROUND(x, 9)) AS xs) FROM fl)"""


def line(features: int, loss: str, steps: int) -> str:
    """Tables z (customer_id, y, tr, x0..: standardised) and w (weights w0.., b by step t) after :func:`filled`."""
    k = range(features)
    if loss == "logistic":
        pull, rate, decay = "1 / (1 + exp(-least(greatest(g, -30), 30))) - y", f"{gradient.LOGISTIC['lr']!r}::double", "0"
    else:
        pull, rate, decay = "CASE WHEN (2 * y - 1) * g < 1 THEN -c * (2 * y - 1) ELSE 0 END", f"({gradient.HINGE['lr']!r}::double / sqrt(t + 1))", "1"
    step = ", ".join(f"any_value(w{i}) - {rate} * (avg(({pull}) * x{i}) + {decay} * any_value(w{i}))" for i in k)
    return f"""
, st AS (SELECT {', '.join(f'avg(xs[{i + 1}]) AS a{i}, stddev_pop(xs[{i + 1}]) AS s{i}' for i in k)},
    (count(*) FILTER (y = 0))::double / count(*) FILTER (y = 1) AS ratio FROM fl WHERE tr)
, z AS MATERIALIZED (SELECT customer_id, y, tr, CASE WHEN y = 1 THEN ratio ELSE 1 END AS c,
    {', '.join(f'(xs[{i + 1}] - a{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS x{i}' for i in k)} FROM fl, st)
, w AS (
  SELECT 0 AS t, {', '.join(f'0.0::double AS w{i}' for i in k)}, 0.0::double AS b
  UNION ALL
  SELECT t + 1, {step}, any_value(b) - {rate} * avg({pull}) FROM (SELECT *, {margin(features)} AS g FROM w, z WHERE t < {steps} AND tr) GROUP BY t
)"""


def margin(features: int) -> str:
    return " + ".join(f"w{i} * x{i}" for i in range(features)) + " + b"


def copies(trees: int, seed: int, key: str = "customer_id") -> str:
    """Table dr (customer_id, tree, copies): the bootstrap samples of the training rows."""
    mark = f"('0x' || substr(md5({key}::varchar || '|' || tree || '|{seed}'), 1, 8))::bigint"
    counts = " + ".join(f"({mark} >= {s})::integer" for s in poisson_steps())
    return f"""
, dr AS MATERIALIZED (SELECT {key}, tree, {counts} AS copies FROM (SELECT {key} FROM fl WHERE tr), (SELECT unnest(range({trees})) AS tree))"""


def tree_nodes(features: int, rule: Rule, forest: bool) -> str:
    """Table nodes (tree, node, f, thr, value, n, gini, score) and scored rows end (customer_id, tree, node), after :func:`filled`.

    Level by level: node sizes s, candidate values g, cuts c, counts left of each cut e, best cut k, rows moved on r.
    """
    drawn = "fr JOIN dr USING (customer_id), range(copies)" if forest else "fr"
    text = f"""
, r0 AS MATERIALIZED (SELECT {'tree' if forest else '0'} AS tree, 1::bigint AS node, y, xs FROM {drawn} WHERE tr)
, u0 AS MATERIALIZED (SELECT customer_id, tree, 1::bigint AS node, xs FROM fr, (SELECT DISTINCT tree FROM r0) WHERE NOT tr)"""
    impurity = lambda p, n: f"(1 - ((1 - {p} / {n}) * (1 - {p} / {n}) + ({p} / {n}) * ({p} / {n})))"
    take = rule.take if rule.take and rule.take < features else None
    levels = range(rule.depth + 1)
    for i in levels:
        text += f"""
, s{i} AS MATERIALIZED (SELECT tree, node, count(*)::double AS n, sum(y)::double AS p FROM r{i} GROUP BY 1, 2)"""
        if i == rule.depth:
            break
        text += f"""
, o{i} AS (SELECT tree, node, unnest(range({features})) AS f FROM s{i} WHERE n >= {rule.least} AND p BETWEEN 1 AND n - 1)
, a{i} AS MATERIALIZED (SELECT tree, node, f FROM o{i} {f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('{rule.seed}|' || tree || '|' || node || '|' || f)) <= {take}" if take else ""})
, g{i} AS MATERIALIZED (SELECT tree, node, f, xs[f + 1] AS v, y FROM r{i} JOIN a{i} USING (tree, node))
, cc{i} AS (SELECT DISTINCT tree, node, f, ROUND(unnest(quantile_cont(v, {CUTS!r})), 9) AS thr FROM g{i} GROUP BY tree, node, f)
, e{i} AS (SELECT tree, node, f, thr, count(*)::double AS l, sum(y)::double AS lp FROM g{i} JOIN cc{i} USING (tree, node, f) WHERE v <= thr GROUP BY 1, 2, 3, 4)
, q{i} AS (SELECT tree, node, f, thr, n, p, l / n * {impurity('lp', 'l')} + (n - l) / n * {impurity('(p - lp)', '(n - l)')} AS score FROM e{i} JOIN s{i} USING (tree, node) WHERE l < n)
, k{i} AS MATERIALIZED (
  SELECT tree, node, f, thr, score FROM (SELECT * FROM q{i} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score, f, thr) = 1) WHERE score < {impurity('p', 'n')})
, r{i + 1} AS MATERIALIZED (SELECT tree, 2 * node + (xs[f + 1] > thr)::integer AS node, y, xs FROM r{i} JOIN k{i} USING (tree, node))
, u{i + 1} AS MATERIALIZED (
  SELECT customer_id, tree, CASE WHEN f IS NULL THEN node ELSE 2 * node + (xs[f + 1] > thr)::integer END AS node, xs FROM u{i} LEFT JOIN k{i} USING (tree, node))"""
    part = lambda i: (
        f"SELECT tree, node, f, thr, (2 * p >= n)::integer AS value, n::bigint AS n, {impurity('p', 'n')} AS gini, score FROM s{i} LEFT JOIN k{i} USING (tree, node)"
        if i < rule.depth
        else f"SELECT tree, node, NULL, NULL, (2 * p >= n)::integer, n::bigint, {impurity('p', 'n')}, NULL FROM s{i}"
    )
    return text + f"\n, nodes AS MATERIALIZED ({' UNION ALL '.join(map(part, levels))})\n, ends AS (SELECT customer_id, tree, node FROM u{rule.depth})"


def node_rows(features: Sequence[str]) -> str:
    """Select of a node table with names and weighted impurity decreases."""
    names = "['" + "', '".join(features) + "']"
    return f"""SELECT tree::integer AS tree, node, ({names})[f + 1] AS feature, round(thr, 4) AS threshold, value, n, round(gini, 6) AS gini, round(score, 6) AS score,
  round((gini - score) * n / max(n) OVER (PARTITION BY tree), 6) AS gain FROM nodes"""


def votes() -> str:
    """Select of the share of votes per hold-out row."""
    return "SELECT customer_id, avg(value)::double AS p FROM ends JOIN nodes USING (tree, node) GROUP BY customer_id"


def boosted_round(features: Sequence[str], distinct: int, percentiles: int) -> str:
    """Tables bb (the best cut of the first round) after :func:`filled` with a double target."""
    probs = [i / (percentiles - 1) for i in range(percentiles)]
    return f"""
, ys AS (SELECT avg(y) AS my, stddev_pop(y) AS sy FROM fr)
, lv AS MATERIALIZED (SELECT unnest(range({len(features)})) AS f, unnest(xs) AS v, (y - my) / sy AS r FROM fr, ys)
, dv AS MATERIALIZED (SELECT DISTINCT f, v FROM lv)
, nd AS (SELECT f, count(*) AS n FROM dv GROUP BY f)
, cv AS MATERIALIZED (SELECT f, v AS cut FROM dv JOIN nd USING (f) WHERE n <= {distinct}
    UNION SELECT f, unnest(quantile_disc(v, {probs!r})) FROM dv JOIN nd USING (f) WHERE n > {distinct} GROUP BY f)
, ev AS (SELECT f, cut, (count(*) FILTER (v < cut))::double AS l, sum(r) FILTER (v < cut) AS s, count(*)::double AS n, sum(r) AS t FROM lv JOIN cv USING (f) GROUP BY 1, 2)
, bb AS (SELECT * FROM ev WHERE l > 0 ORDER BY ROUND(s * s / l + (t - s) * (t - s) / (n - l), 9) DESC, f, cut LIMIT 1)"""
