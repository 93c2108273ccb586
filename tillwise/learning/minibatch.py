"""Polynomial regression by mini-batch gradient descent, exact and distributed.

A step on a batch is an affine map of the weights: with A the batch's moments and r its products with the
target, w becomes (I - 2 lr / n A) w + 2 lr / n r. An epoch is the product of its batches' maps in order,
and products can be taken in parts: a task multiplies the maps of neighbouring batches, parts are
multiplied ``FAN`` at a time, and the last few reach the driver, which applies them one after another. The
result is that of taking the batches one by one, up to rounding. The loss that the steps met on
their way is a quadratic form of the first weights and travels with each map.

Rows, shuffled in an order by key hash per epoch (:mod:`..operators.batches`), never leave their batch. A
task holds ``RUN`` batches and matrices of the number of terms squared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations_with_replacement
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clean, total
from ..operators.batches import batch_numbers
from ..operators.scaling import fit_means, impute, polynomial_terms
from ..session import Stages, ship_package

#: Passes and step size.
POLYNOMIAL = {"epochs": 5, "lr": 1e-5}
#: Rows of a batch.
BATCH = 4096
#: Batches whose maps one task multiplies.
RUN = 16
#: Maps that are multiplied at a time.
FAN = 64

MAP_SCHEMA = "part long, n double, m array<double>, v array<double>, q array<double>, u array<double>, c double"


@dataclass(frozen=True)
class PolynomialModel:
    """Weights of the standardised terms, and all that a later run needs to go on."""

    features: list[str]
    degree: int
    means: dict[str, float]
    centers: list[float]
    spreads: list[float]
    target_mean: float
    target_spread: float
    weights: list[float]
    bias: float = 0.0
    steps: int = 0
    history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {f: F.coalesce(clean(f), F.lit(self.means[f])) for f in self.features}
        terms = [reduce(mul, [filled[f] for f in name.split("*")]) for name in polynomial_terms(self.features, self.degree)]
        scaled = total([F.lit(w / s) * (t - c) for w, t, c, s in zip(self.weights, terms, self.centers, self.spreads)])
        return df.withColumn("prediction", (scaled + self.bias) * self.target_spread + self.target_mean)


def expand(x: np.ndarray, degree: int) -> np.ndarray:
    """All products of up to ``degree`` columns, in the order of :func:`polynomial_terms`."""
    k = range(x.shape[1])
    return np.column_stack([np.prod(x[:, list(c)], axis=1) for d in range(1, degree + 1) for c in combinations_with_replacement(k, d)])


def compose(first: dict, then: dict) -> dict:
    """One map for ``first`` and then ``then``; losses as forms of the weights before ``first``."""
    m, v = first["m"], first["v"]
    return {
        "n": first["n"] + then["n"],
        "m": then["m"] @ m,
        "v": then["m"] @ v + then["v"],
        "q": first["q"] + m.T @ then["q"] @ m,
        "u": first["u"] + m.T @ (then["q"] @ v + then["u"]),
        "c": first["c"] + v @ then["q"] @ v + 2.0 * then["u"] @ v + then["c"],
    }


def step_map(x: np.ndarray, y: np.ndarray, lr: float) -> dict:
    """The map of one batch; the last column of ``x`` is ones, for the bias."""
    moments, pull, n = x.T @ x, x.T @ y, float(len(y))
    rate = 2.0 * lr / n
    return {"n": n, "m": np.eye(x.shape[1]) - rate * moments, "v": rate * pull, "q": moments, "u": -pull, "c": float(y @ y)}


def as_table(part: int, found: dict) -> pa.Table:
    lists = {k: pa.array([found[k].ravel()], pa.list_(pa.float64())) for k in ("m", "v", "q", "u")}
    order = ["part", "n", "m", "v", "q", "u", "c"]
    return pa.table({"part": pa.array([part], pa.int64()), "n": [found["n"]], "c": [found["c"]], **lists}).select(order)


def read_map(row) -> dict:
    v = np.array(row["v"])
    square = lambda k: np.array(row[k]).reshape(len(v), len(v))
    return {"n": row["n"], "m": square("m"), "v": v, "q": square("q"), "u": np.array(row["u"]), "c": row["c"]}


def epoch_maps(rows: DataFrame, model: PolynomialModel, lr: float) -> DataFrame:
    """A map per ``RUN`` neighbouring batches of ``x0.., y, pos, batch``."""
    d, degree = len(model.features), model.degree
    centers, spreads = np.array(model.centers), np.array(model.spreads)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        x = expand(np.column_stack([group.column(f"x{i}").to_numpy() for i in range(d)]), degree)
        x = np.column_stack([(x - centers) / spreads, np.ones(len(x))])
        y, batch = group.column("y").to_numpy(), group.column("batch").to_numpy()
        found = None
        for cut in np.split(np.arange(len(y)), np.flatnonzero(np.diff(batch)) + 1):
            here = step_map(x[cut], y[cut], lr)
            found = here if found is None else compose(found, here)
        return as_table(group.column("part")[0].as_py(), found)

    return rows.withColumn("part", F.expr(f"batch div {RUN}")).groupBy("part").applyInArrow(run, MAP_SCHEMA)


def multiplied(maps: DataFrame, stages: Stages) -> list[dict]:
    """At most ``FAN`` maps that do in order what all do."""
    maps, fan = stages.keep(maps, "maps"), FAN
    while maps.count() > fan:

        def run(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["part"])
            found = read_map(rows[0])
            for row in rows[1:]:
                found = compose(found, read_map(row))
            return as_table(rows[0]["part"] // fan, found)

        maps = stages.keep(maps.groupBy(F.expr(f"part div {fan}").alias("lot")).applyInArrow(run, MAP_SCHEMA), "maps")
    return [read_map(r) for r in sorted(maps.collect(), key=lambda r: r["part"])]


def fresh(df: DataFrame, features: Sequence[str], label: str, degree: int) -> PolynomialModel:
    """A model without steps: means of the features, centers and spreads of their terms and of the target."""
    means = fit_means(df, features)
    terms = polynomial_terms(features, degree)
    filled = impute(df, means)
    figures = [f(t).alias(f"{n}_{i}") for i, t in enumerate(terms.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = filled.agg(*figures, F.avg(label).alias("m"), F.stddev_pop(label).alias("s")).first()
    k = range(len(terms))
    return PolynomialModel(
        list(features), degree, means, [row[f"m_{i}"] for i in k], [row[f"s_{i}"] or 1.0 for i in k], row["m"], row["s"] or 1.0, [0.0] * len(terms)
    )


def fit_polynomial(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", degree: int = 2, epochs: int = POLYNOMIAL["epochs"],
    lr: float = POLYNOMIAL["lr"], batch: int = BATCH, seed: int = 42, start: PolynomialModel | None = None,
) -> PolynomialModel:
    """``epochs`` passes, each in an order of its own. ``start`` goes on from a model, with its scales and its epochs counted."""
    if start is not None and (start.features != list(features) or start.degree != degree):
        raise ValueError("the model to go on from was trained on other features")
    ship_package(df.sparkSession)
    with Stages(df.sparkSession) as stages:
        known = df.where(clean(label).isNotNull()).withColumn(label, clean(label))
        model = start or fresh(known, features, label, degree)
        filled = impute(known, model.means)
        y = (F.col(label) - model.target_mean) / model.target_spread
        rows = stages.keep(filled.select(key, *[F.col(f).alias(f"x{i}") for i, f in enumerate(features)], y.alias("y")), "polynomial")
        w, history = np.array([*model.weights, model.bias]), list(model.history)
        for epoch in range(model.steps, model.steps + epochs):
            with Stages(df.sparkSession) as own:
                lost = n = 0.0
                for found in multiplied(epoch_maps(batch_numbers(rows, key, batch, own, seed + epoch), model, lr), own):
                    lost += w @ found["q"] @ w + 2.0 * found["u"] @ w + found["c"]
                    n += found["n"]
                    w = found["m"] @ w + found["v"]
                history.append(float(lost / n))
    weights = [float(v) for v in w[:-1]]
    return replace(model, weights=weights, bias=float(w[-1]), steps=model.steps + epochs, history=history)
