"""Linear classifiers trained by full-batch steps: logistic and weighted hinge loss, resumable.

The features are filled with their means, standardised and stored once. A step is one scan of that
table: every batch of rows gives its gradient sums by two matrix products, the sums are added up
before and after a shuffle of one row per task, and d + 2 numbers reach the driver. For a table of at most
``LOCAL`` rows a job would cost far more than its step; such a table takes all steps within one task.

A model holds all that a later run needs to go on: weights, the number of steps taken, and the means and
spreads it was trained with. 75 steps, a stop, and 75 more are the same as 150.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clean, flag, sigmoid, total
from ..operators.scaling import class_weights, fit_means, impute
from ..session import Stages, ship_package

#: Rows that one task may hold for all steps.
LOCAL = 50_000
LOGISTIC = {"epochs": 100, "lr": 0.01}
HINGE = {"epochs": 100, "lr": 0.001}


@dataclass(frozen=True)
class LineModel:
    """A linear classifier on standardised features, and the state of its training."""

    loss: str
    features: list[str]
    means: dict[str, float]
    spreads: dict[str, float]
    weights: list[float]
    bias: float = 0.0
    steps: int = 0
    history: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        scaled = [(F.coalesce(clean(f), F.lit(self.means[f])) - self.means[f]) / self.spreads[f] for f in self.features]
        return total([F.lit(w) * x for w, x in zip(self.weights, scaled)]) + F.lit(self.bias)

    def transform(self, df: DataFrame) -> DataFrame:
        """Logistic: ``score`` is the probability, the class is 1 from one half on. Hinge: the class is 1 from margin 0 on."""
        if self.loss == "logistic":
            p = sigmoid(self.margin())
            return df.withColumn("score", p).withColumn("prediction", flag(F.col("score") >= 0.5).cast("double"))
        return df.withColumn("prediction", flag(self.margin() >= 0).cast("double"))

    def coefficients(self, spark) -> DataFrame:
        """``(term, weight)`` on the standardised scale, the bias as ``intercept``."""
        rows = [*zip(self.features, map(float, self.weights)), ("intercept", float(self.bias))]
        return spark.createDataFrame(rows, "term string, weight double")


def fresh(df: DataFrame, features: Sequence[str], loss: str) -> LineModel:
    """A model without steps: zero weights, means and spreads of ``df``. Constant columns are divided by 1."""
    means = fit_means(df, features)
    row = impute(df, means).agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    return LineModel(loss, list(features), means, {f: row[f] or 1.0 for f in features}, [0.0] * len(features))


def matrix(df: DataFrame, model: LineModel, label: str) -> DataFrame:
    """Standardised features and label as doubles. Rows whose label is neither 0 nor 1 are left out."""
    filled = impute(df.where(F.col(label).isin(0, 1)), model.means)
    scaled = [((F.col(f) - model.means[f]) / model.spreads[f]).alias(f"x{i}") for i, f in enumerate(model.features)]
    return filled.select(*scaled, F.col(label).cast("double").alias("y"))


#: What a batch adds to the sums: (margins, labels, class costs) -> (pull of each row, loss of each row).
Pull = Callable[[np.ndarray, np.ndarray, tuple[float, float]], tuple[np.ndarray, np.ndarray]]


def logistic_pull(z: np.ndarray, y: np.ndarray, costs: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    z = np.clip(z, -30.0, 30.0)
    return 1.0 / (1.0 + np.exp(-z)) - y, np.logaddexp(0.0, z) - y * z


def hinge_pull(z: np.ndarray, y: np.ndarray, costs: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Rows within the margin pull by their class's cost."""
    sign, cost = 2.0 * y - 1.0, np.where(y == 1.0, costs[0], costs[1])
    short = 1.0 - sign * z
    return np.where(short > 0.0, -cost * sign, 0.0), cost * np.maximum(short, 0.0)


def sums(rows: DataFrame, model: LineModel, pull: Pull, costs: tuple[float, float]) -> np.ndarray:
    """Sums of pull times feature, of the pulls and of the losses over all rows: one scan."""
    d = len(model.features)
    weights, bias = np.array(model.weights), model.bias
    names = [f"s{i}" for i in range(d + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + 2)
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(d)])
            g, loss = pull(x @ weights + bias, batch.column(d).to_numpy(), costs)
            out += [*(g @ x), g.sum(), loss.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names)

    partial = rows.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    return np.array(partial.agg(*[F.sum(n).alias(n) for n in names]).first(), float)


def moved(
    loss: str, w: np.ndarray, b: float, found: np.ndarray, steps: int, lr: float, l2: float
) -> tuple[np.ndarray, float, float]:
    """Weights and bias after step number ``steps``, and the loss before it, from mean sums."""
    if loss == "logistic":
        rate, gradient, value = lr, found[:-2] + l2 * w, found[-1] + l2 / 2.0 * w @ w
    else:
        rate, gradient, value = lr / math.sqrt(steps + 1.0), found[:-2] + w, found[-1] + 0.5 * w @ w
    return w - rate * gradient, float(b - rate * found[-2]), float(value)


def local_steps(rows: DataFrame, model: LineModel, pull: Pull, costs: tuple[float, float], epochs: int, lr: float, l2: float) -> LineModel:
    """All steps over a bounded table, in one task."""
    d, loss, done = len(model.features), model.loss, model.steps
    weights, bias = np.array(model.weights), model.bias

    def run(group: pa.Table) -> pa.Table:
        x = np.column_stack([group.column(f"x{i}").to_numpy() for i in range(d)])
        y = group.column("y").to_numpy()
        order = np.lexsort([y, *x.T])  # an order of the rows' own, whatever the shuffle gave
        x, y, w, b, history = x[order], y[order], weights, bias, []
        for t in range(done, done + epochs):
            g, lost = pull(x @ w + b, y, costs)
            w, b, value = moved(loss, w, b, np.array([*(g @ x), g.sum(), lost.sum()]) / len(y), t, lr, l2)
            history.append(value)
        lists = pa.list_(pa.float64())
        return pa.table({"w": pa.array([w], lists), "b": pa.array([b], pa.float64()), "history": pa.array([history], lists)})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "w array<double>, b double, history array<double>").first()
    return replace(model, weights=list(found["w"]), bias=found["b"], steps=done + epochs, history=[*model.history, *found["history"]])


def train(
    df: DataFrame, features: Sequence[str], label: str, loss: str, epochs: int, lr: float, l2: float = 0.0,
    cost: float = 1.0, start: LineModel | None = None, local: int = LOCAL,
) -> LineModel:
    """``epochs`` more full-batch steps. ``start`` goes on from a model, with its means and spreads.

    Logistic: the gradient of the mean loss plus ``l2`` times the weights. Hinge: half the squared
    weights plus the mean cost-weighted hinge loss, the positive class weighted by the class ratio, with
    steps that shrink with the root of their number.
    """
    if start is not None and (start.features != list(features) or start.loss != loss):
        raise ValueError("the model to go on from was trained on other features or another loss")
    ship_package(df.sparkSession)
    pull = logistic_pull if loss == "logistic" else hinge_pull
    with Stages(df.sparkSession) as stages:
        model = start or fresh(df, features, loss)
        rows = stages.keep(matrix(df, model, label), "gradient")
        n = rows.count()
        if n == 0:
            raise ValueError("no row with a label")
        ratio = class_weights(rows, "y", cost).first()
        costs = (ratio["margin_positive_cost"], ratio["margin_negative_cost"])
        if n <= local:
            return local_steps(rows, model, pull, costs, epochs, lr, l2)
        for _ in range(epochs):
            found = sums(rows, model, pull, costs) / n
            w, b, value = moved(loss, np.array(model.weights), model.bias, found, model.steps, lr, l2)
            weights = [float(v) for v in w]
            model = replace(model, weights=weights, bias=b, steps=model.steps + 1, history=[*model.history, value])
    return model


def fit_logistic(df, features, label="label", epochs=LOGISTIC["epochs"], lr=LOGISTIC["lr"], l2=0.0, start=None, local=LOCAL) -> LineModel:
    return train(df, features, label, "logistic", epochs, lr, l2=l2, start=start, local=local)


def fit_hinge(df, features, label="label", epochs=HINGE["epochs"], lr=HINGE["lr"], cost=1.0, start=None, local=LOCAL) -> LineModel:
    return train(df, features, label, "hinge", epochs, lr, cost=cost, start=start, local=local)
