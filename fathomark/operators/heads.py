"""Classifier heads of many candidates and cells, fitted in step: one Spark aggregate carries the gradients of all.

Rows carry a cell, a class number, a vector and a hash of the item. A step evaluates every head that still moves: each task
adds up losses and gradients of the heads of its rows' cells, and the partial arrays are added in two levels. Linear heads
take quasi-Newton steps on all rows; the perceptron takes Adam steps on rows drawn by hash. A head that reaches its cap
before its gradient is small has not converged and is no candidate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .descent import Solution, Solver, drive, lbfgs
from .sums import added

MAX_STEPS = {"logreg": 1000, "svm_linear": 1000, "mlp": 400}
TOLERANCE = {"logreg": 1e-4, "svm_linear": 1e-4, "mlp": 0.1}
# Rows of a perceptron step: this many searched batches, so that a step is worth a job.
BATCHES = 64
_U = np.uint64


@dataclass(frozen=True)
class Head:
    """One candidate: family, searched parameters, and what its cell's training rows look like."""

    cell: str
    family: str
    params: Mapping
    d: int
    counts: tuple[int, ...]

    @property
    def n(self) -> int:
        return sum(self.counts)

    @property
    def layers(self) -> list[int]:
        hidden = [int(self.params.get("hidden", 64))] * int(self.params.get("depth", 1)) if self.family == "mlp" else []
        return [self.d, *hidden, len(self.counts)]

    @property
    def class_weights(self) -> np.ndarray:
        counts = np.asarray(self.counts, float)
        if self.params.get("class_weight") != "balanced":
            return np.ones(len(counts))
        return np.divide(self.n, len(counts) * counts, out=np.zeros_like(counts), where=counts > 0)

    def start(self) -> np.ndarray:
        sizes = self.layers
        if self.family != "mlp":
            return np.zeros((sizes[0] + 1) * sizes[1])
        rng = np.random.default_rng(int(self.params.get("seed", 0)))
        parts = [np.vstack([rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]
        return np.concatenate([p.ravel() for p in parts])

    def solver(self, cap: int) -> Solver:
        tol = TOLERANCE[self.family]
        if self.family == "mlp":
            return _adam(self.start(), self.params["lr"], self.params.get("weight_decay", 0.0), cap, tol)
        return lbfgs(self.start(), cap, tol)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _adam(x: np.ndarray, lr: float, decay: float, steps: int, tol: float) -> Solver:
    """Adam with decoupled weight decay; ends where the running mean of the gradient has ``tol`` of its first norm."""
    first = start = None
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        value, grad = yield x
        if first is None:
            first, start = max(float(np.linalg.norm(grad)), 1e-12), value
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        steady, scale = mean / (1 - 0.9**step), np.sqrt(square / (1 - 0.99**step))
        size = float(np.linalg.norm(steady))
        if size <= tol * first:
            return Solution(x, value, size, step, True, start)
        x = x - lr * (steady / (scale + 1e-8) + decay * x)
    return Solution(x, value, size, steps, False, start)


def _split(head: Head, theta: np.ndarray) -> list[np.ndarray]:
    sizes, out, at = head.layers, [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(theta[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def margins(head: Head, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    parts = _split(head, theta)
    for w in parts[:-1]:
        x = np.maximum(x @ w[:-1] + w[-1], 0)
    return x @ parts[-1][:-1] + parts[-1][-1]


def _loss(head: Head, theta: np.ndarray, x: np.ndarray, y: np.ndarray, drop) -> tuple[float, np.ndarray]:
    """Sum of losses of the rows and its gradient. ``drop(layer, width)`` gives a layer's scaled mask or None."""
    parts, weight = _split(head, theta), head.class_weights
    inputs, masks = [x], []
    for k, w in enumerate(parts[:-1]):
        on = np.maximum(inputs[-1] @ w[:-1] + w[-1], 0)
        mask = drop(k, on.shape[1])
        masks.append(mask)
        inputs.append(on if mask is None else on * mask)
    z = inputs[-1] @ parts[-1][:-1] + parts[-1][-1]
    truth = np.eye(z.shape[1])[y]
    if head.family == "svm_linear":
        sign, each = 2 * truth - 1, np.where(truth > 0, weight[y][:, None], 1.0)
        short = np.maximum(1 - sign * z, 0)
        value, g = float((each * short * short).sum()), -2 * each * sign * short
    else:
        z = z - z.max(1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(1, keepdims=True))
        value, g = float(-(weight[y] * logs[np.arange(len(y)), y]).sum()), (np.exp(logs) - truth) * weight[y][:, None]
    grads = []
    for k in range(len(parts) - 1, -1, -1):
        grads.append(np.vstack([inputs[k].T @ g, g.sum(0, keepdims=True)]).ravel())
        if k:
            g = g @ parts[k][:-1].T
            if masks[k - 1] is not None:
                g = g * masks[k - 1]
            g = g * (inputs[k] > 0)
    return value, np.concatenate(grads[::-1])


def _draw(head: Head, step: int, h: np.ndarray) -> np.ndarray:
    """Rows of a perceptron step: about BATCHES searched batches, drawn by the item's hash and the step."""
    share = BATCHES * int(head.params.get("batch_size", 64)) / max(head.n, 1)
    if head.family != "mlp" or share >= 1:
        return np.ones(len(h), bool)
    return (_mix(h ^ _mix(np.full(1, step, np.uint64))) >> _U(11)) < _U(int(share * 2**53))


def _dropout(head: Head, step: int, h: np.ndarray):
    rate = float(head.params.get("dropout", 0.0)) if head.family == "mlp" else 0.0

    def drop(layer: int, width: int):
        if rate <= 0:
            return None
        unit = np.arange(width, dtype=np.uint64) * _U(0x9FB21C651E98DF25) + _U((1 + layer) * 1_000_003 + step)
        return ((_mix(h[:, None] ^ _mix(unit)[None, :]) >> _U(11)) >= _U(int(rate * 2**53))) / (1 - rate)

    return drop


def evaluate(rows: DataFrame, heads: Mapping[str, Head], points: Mapping[str, np.ndarray], turn: Mapping[str, int]) -> dict:
    """Mean loss with its penalty, and the gradient, of every named head at its point: one job for all of them."""
    by_cell: dict[str, list] = {}
    for name, theta in points.items():
        by_cell.setdefault(heads[name].cell, []).append((name, heads[name], theta, turn[name]))
    shared = rows.sparkSession.sparkContext.broadcast(by_cell)

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                x, y = np.stack(part["v"].to_numpy()), part["y"].to_numpy()
                h = part["h"].to_numpy().view(np.uint64)
                for name, head, theta, step in shared.value.get(cell, ()):
                    use = _draw(head, step, h)
                    if use.any():
                        value, grad = _loss(head, theta, x[use], y[use], _dropout(head, step, h[use]))
                        new = np.concatenate([[use.sum(), value], grad])
                        total[name] = total[name] + new if name in total else new
        if total:
            yield pd.DataFrame({"name": list(total), "part": list(total.values())})

    got = {r["name"]: np.asarray(r["part"]) for r in added(rows.mapInPandas(partial, "name string, part array<double>"), ["name"]).collect()}
    shared.unpersist()
    out = {}
    for name, theta in points.items():
        head = heads[name]
        found = got.get(name, np.zeros(2 + len(theta)))
        n = max(found[0], 1.0)
        value, grad = found[1] / n, found[2:] / n
        if head.family != "mlp":
            pull = theta / (head.params["C"] * head.n)
            if head.family == "logreg":  # the intercept is free
                pull.reshape(head.d + 1, -1)[-1] = 0.0
            value, grad = value + 0.5 * float(pull @ theta), grad + pull
        out[name] = value, grad
    return out


def training_rows(train: DataFrame, classes: Sequence[str], label: str, cell: str | None = None, item: str = "item_id") -> DataFrame:
    """(cell, y, v, h): what heads are fitted on."""
    names = F.array(*[F.lit(c) for c in classes])
    key = F.lit("") if cell is None else F.col(cell)
    seen = F.xxhash64(item) if item in train.columns else F.xxhash64("v")
    return train.select(key.alias("cell"), (F.array_position(names, F.col(label)) - 1).cast("long").alias("y"), "v", seen.alias("h"))


def shapes(rows: DataFrame, classes: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Dimensions and class counts of every cell."""
    counts = [F.count_if(F.col("y") == k).alias(f"c{k}") for k in range(classes)]
    return {r["cell"]: (r["d"], tuple(r[f"c{k}"] for k in range(classes))) for r in rows.groupBy("cell").agg(F.max(F.size("v")).alias("d"), *counts).collect()}


def fit_all(rows: DataFrame, heads: Mapping[str, Head]) -> dict[str, Solution]:
    """Every head's solution; ``rows`` are read once and kept while the heads move."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    turn: Counter = Counter()

    def at(points):
        turn.update(points.keys())
        return evaluate(rows, heads, points, turn)

    try:
        return drive({name: h.solver(int(h.params.get("max_iter", MAX_STEPS[h.family]))) for name, h in heads.items()}, at)
    finally:
        rows.unpersist()


def predict(df: DataFrame, head: Head, theta: np.ndarray, classes: Sequence[str]) -> DataFrame:
    """``df`` with y_pred and p (probabilities, or margins of a linear machine)."""
    model = df.sparkSession.sparkContext.broadcast((head, theta))

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        head_, theta_ = model.value
        z = margins(head_, theta_, np.stack(v.to_numpy()))
        if head_.family != "svm_linear":
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
        return pd.Series(list(z))

    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return df.withColumn("p", scores("v")).withColumn("y_pred", F.get(F.array(*[F.lit(c) for c in classes]), best))
