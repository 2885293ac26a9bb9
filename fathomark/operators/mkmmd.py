"""An affine map of one set of vectors that minimises multi-kernel MMD^2 to another, fitted on all rows of both.

A Gaussian kernel is the mean of cos(w . (x - y)) over normal frequencies w, so with random Fourier features the
discrepancy is a difference of feature means. Its gradient in W and b needs only the sums of cos, sin, cos * x and
sin * x over the moved rows: a step is one aggregate over all rows, reduced per task and added in two levels. Its size
depends on features and dimensions alone. Frequencies are hash draws, so any engine can state the objective.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .descent import drive, lbfgs
from .mmd import MULTIPLIERS
from .sums import added

BLOCK = 16


def _uniform(text: str) -> float:
    return (int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def frequencies(d: int, features: int, bandwidth: float, multipliers: Sequence[float] = MULTIPLIERS, seed: int = 0) -> np.ndarray:
    """(multipliers * features, d) normal draws over each kernel's width, by Box and Muller from hashes of their place."""
    out = np.empty((len(multipliers), features, d))
    for k, m in enumerate(multipliers):
        for j in range(features):
            for i in range(d):
                u, v = (_uniform(f"rff|{seed}|{k}|{j}|{i}|{s}") for s in "uv")
                out[k, j, i] = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v) / (m * bandwidth)
    return out.reshape(-1, d)


@dataclass
class Sums:
    """Rows and, per frequency, the sums of cos and sin, and of both times the row (d columns)."""

    n: int
    cos: np.ndarray
    sin: np.ndarray
    cos_x: np.ndarray | None
    sin_x: np.ndarray | None


def feature_sums(rows: DataFrame, omega: np.ndarray, w: np.ndarray, b: np.ndarray, outer: bool) -> Sums:
    """The sums over all rows of ``v`` moved by x -> W x + b; ``outer`` adds those that the gradient needs."""
    shared = rows.sparkSession.sparkContext.broadcast((omega, w, b))
    width = 2 + 2 * len(b) * outer

    def partial(batches):
        omega_, w_, b_ = shared.value
        turn, add = omega_ @ w_, omega_ @ b_
        total, n = np.zeros((len(omega_), width)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            z = x @ turn.T + add
            c, s = np.cos(z), np.sin(z)
            total[:, 0] += c.sum(0)
            total[:, 1] += s.sum(0)
            if outer:
                total[:, 2 : 2 + len(b_)] += c.T @ x
                total[:, 2 + len(b_) :] += s.T @ x
            n += len(x)
        if n:
            cuts = range(0, len(total), BLOCK)
            yield pd.DataFrame({"block": [k // BLOCK for k in cuts], "part": [np.concatenate([[n], total[k : k + BLOCK].ravel()]) for k in cuts]})

    parts = rows.select("v").mapInPandas(partial, "block int, part array<double>")
    got = sorted(added(parts, ["block"]).collect(), key=lambda r: r["block"])
    shared.unpersist()
    if not got:
        raise ValueError("no rows to fit on")
    all_ = np.concatenate([np.asarray(r["part"])[1:].reshape(-1, width) for r in got])
    d = len(b)
    cx, sx = (all_[:, 2 : 2 + d], all_[:, 2 + d :]) if outer else (None, None)
    return Sums(int(got[0]["part"][0]), all_[:, 0], all_[:, 1], cx, sx)


def discrepancy(a: Sums, t: Sums, kernels: int) -> np.ndarray:
    """Unbiased MMD^2 of each kernel: pairs of a row with itself count 1 each and are taken out."""
    if min(a.n, t.n) < 2:
        raise ValueError("either side needs two rows")
    ca, sa, ct, st = (v.reshape(kernels, -1) / n for v, n in ((a.cos, a.n), (a.sin, a.n), (t.cos, t.n), (t.sin, t.n)))
    own = [(n * (c * c + s * s).mean(1) - 1) / (n - 1) for c, s, n in ((ca, sa, a.n), (ct, st, t.n))]
    return own[0] + own[1] - 2 * (ca * ct + sa * st).mean(1)


def objective(a: Sums, t: Sums, omega: np.ndarray, w: np.ndarray, lam: float, kernels: int) -> tuple[float, np.ndarray, np.ndarray]:
    """sum of MMD^2 + lam * |W - I|^2 with its gradients in W and b."""
    away = w - np.eye(len(w))
    value = float(discrepancy(a, t, kernels).sum() + lam * (away**2).sum())
    each = len(omega) // kernels
    pull_cos, pull_sin = (2 / each * (x / (a.n - 1) - y / t.n) for x, y in ((a.cos, t.cos), (a.sin, t.sin)))
    # d cos(z) = -sin(z) dz and d sin(z) = cos(z) dz, with dz = omega (dW x + db).
    grad_w = omega.T @ (pull_sin[:, None] * a.cos_x - pull_cos[:, None] * a.sin_x) / a.n
    grad_b = omega.T @ (pull_sin * a.cos - pull_cos * a.sin) / a.n
    return value, grad_w + 2 * lam * away, grad_b


@dataclass
class Fit:
    w: np.ndarray
    b: np.ndarray
    start_mmd2: float
    final_mmd2: float
    reverted: bool
    converged: bool
    grad_norm: float
    steps: int


def fit(source: DataFrame, target: DataFrame, w0: np.ndarray, b0: np.ndarray, bandwidth: float, *, lam: float, diagonal: bool,
        steps: int = 60, features: int = 48, tol: float = 1e-3, seed: int = 0) -> Fit:
    """W and b from the start (w0, b0) by quasi-Newton steps; the start is kept where the end is not better on all rows."""
    d, kernels = len(b0), len(MULTIPLIERS)
    omega = frequencies(d, features, bandwidth, seed=seed)
    rows = source.select("v").persist(StorageLevel.MEMORY_AND_DISK)
    here = np.eye(d), np.zeros(d)
    try:
        goal = feature_sums(target, omega, *here, outer=False)

        def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (np.diag(x[:d]) if diagonal else x[: d * d].reshape(d, d)), x[-d:]

        def at(points: dict) -> dict:
            out = {}
            for name, x in points.items():
                w, b = split(x)
                value, gw, gb = objective(feature_sums(rows, omega, w, b, outer=True), goal, omega, w, lam, kernels)
                out[name] = value, np.concatenate([np.diag(gw) if diagonal else gw.ravel(), gb])
            return out

        begin = np.concatenate([np.diag(w0) if diagonal else w0.ravel(), b0])
        end = drive({"map": lbfgs(begin, steps, tol)}, at)["map"]
        w, b = split(end.x)
        start, final = (float(discrepancy(feature_sums(rows, omega, *m, outer=False), goal, kernels).sum()) for m in ((w0, b0), (w, b)))
    finally:
        rows.unpersist()
    worse = final > start
    return Fit(w0 if worse else w, b0 if worse else b, start, min(start, final), worse, end.converged, end.grad_norm, end.steps)
