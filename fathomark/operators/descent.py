"""Minimisers whose function values come from Spark jobs.

A solver is a generator: it yields the point to look at and is sent the value and the gradient there. Many solvers run
in step, so one job evaluates the points of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Mapping
from dataclasses import dataclass

import numpy as np

Solver = Generator[np.ndarray, tuple[float, np.ndarray], "Solution"]


@dataclass
class Solution:
    """Where a solver ended. ``converged``: the gradient is small, or the value cannot fall further in double precision."""

    x: np.ndarray
    value: float
    grad_norm: float
    steps: int
    converged: bool
    start: float


def lbfgs(x: np.ndarray, steps: int, tol: float = 1e-4, memory: int = 8) -> Solver:
    """Limited-memory quasi-Newton steps with halving; ends where the gradient has ``tol`` of its first norm."""
    value, grad = yield x
    start, first = value, max(float(np.linalg.norm(grad)), 1e-12)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps):
        size = float(np.linalg.norm(grad))
        if size <= tol * first:
            return Solution(x, value, size, step, True, start)
        way = -_curved(grad, past)
        slope = float(grad @ way)
        if slope >= 0:
            past.clear()
            way, slope = -grad, -size * size
        length = 1.0 if past else min(1.0, 1.0 / size)
        while True:
            new_value, new_grad = yield x + length * way
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length * -slope < 1e-15 * max(1.0, abs(value)):
                return Solution(x, value, size, step, True, start)
        moved, turned = length * way, new_grad - grad
        if moved @ turned > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(turned):
            past = [*past[-memory + 1 :], (moved, turned)]
        x, value, grad = x + moved, new_value, new_grad
    size = float(np.linalg.norm(grad))
    return Solution(x, value, size, steps, size <= tol * first, start)


def _curved(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse curvature of the last steps applied to the gradient (two-loop recursion)."""
    out, weights = grad.copy(), []
    for moved, turned in reversed(past):
        a = (moved @ out) / (moved @ turned)
        weights.append(a)
        out -= a * turned
    if past:
        moved, turned = past[-1]
        out *= (moved @ turned) / (turned @ turned)
    for (moved, turned), a in zip(past, reversed(weights)):
        out += moved * (a - (turned @ out) / (moved @ turned))
    return out


def drive(solvers: Mapping, evaluate: Callable[[dict], dict]) -> dict:
    """Run all solvers in step; ``evaluate``: {name: point} -> {name: (value, gradient)}, one job for all that still move."""
    done: dict = {}
    points = {name: next(s) for name, s in solvers.items()}
    while points:
        seen, ahead = evaluate(points), {}
        for name in points:
            try:
                ahead[name] = solvers[name].send(seen[name])
            except StopIteration as end:
                done[name] = end.value
        points = ahead
    return done
