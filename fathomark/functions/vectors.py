"""Element-wise vector expressions, evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _check_alphas(alphas: Sequence[float]) -> None:
    if not all(0.0 <= a <= 1.0 for a in alphas):
        raise ValueError(f"every alpha must lie in [0, 1], got {list(alphas)}")


def blend(original: Column, aligned: Column, alpha: float) -> Column:
    """alpha * aligned + (1 - alpha) * original."""
    _check_alphas([alpha])
    return F.zip_with(original, aligned, lambda o, a: alpha * a + (1.0 - alpha) * o)


def blend_vector(original: Column, aligned: Column, alphas: Column) -> Column:
    """The same with one alpha per dimension (array column)."""
    moved = F.zip_with(F.zip_with(aligned, original, lambda a, o: a - o), alphas, lambda d, w: d * w)
    return F.zip_with(original, moved, lambda o, m: o + m)


def blend_groups(original: Column, aligned: Column, groups: Sequence[int], alphas: Sequence[float]) -> Column:
    """One alpha per dimension group; ``groups[j]`` indexes ``alphas``."""
    _check_alphas(alphas)
    if max(groups) >= len(alphas):
        raise ValueError("a group id has no alpha")
    return blend_vector(original, aligned, literal([alphas[g] for g in groups]))


def affine(v: Column, w: Column, b: Column) -> Column:
    """v * w + b per dimension."""
    return F.zip_with(F.zip_with(v, w, lambda x, y: x * y), b, lambda x, y: x + y)


def standardise(v: Column, mean: Column, std: Column, floor: float = 1e-8) -> Column:
    """(v - mean) / std, where a constant dimension keeps scale 1."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / F.when(s < floor, F.lit(1.0)).otherwise(s))


def fuse(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def part(v: Column, index: int, parts: int) -> Column:
    """One of ``parts`` equal pieces of a pooled vector."""
    size = (F.size(v) / parts).cast("int")
    return F.slice(v, size * index + 1, size)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def peak_norm(v: Column) -> Column:
    """Scaled to a largest magnitude of 1; silence is left alone."""
    peak = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.when(peak > 0, x / peak).otherwise(x))


def nonfinite(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
