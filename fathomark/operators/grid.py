"""Enumeration of an experiment grid as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rungs for which blending is not an identity.
BLENDABLE = ("mean_shift", "coral", "mkmmd_diag", "mkmmd_full")


def axis(values: Sequence, kind: str) -> Column:
    """A literal axis, exploded in place: products of axes need no join."""
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))


def variants(rows: Sequence[Mapping], fields: Mapping[str, str]) -> Column:
    """Literal variant structs with the given field types; a missing field is null."""
    return F.array(
        *[F.struct(*[F.lit(r.get(n)).cast(k).alias(n) for n, k in fields.items()]) for r in rows]
    )


def variants_by(column: str, table: Mapping[str, Sequence[Mapping]], fields: Mapping[str, str]) -> Column:
    """Variants that depend on another axis, exploded; unknown values have one all-null variant."""
    blank = variants([{}], fields)
    cases = reduce(
        lambda acc, kv: acc.when(F.col(column) == kv[0], variants(kv[1], fields)),
        table.items(), F.when(F.lit(False), blank),
    )
    return F.explode(cases.otherwise(blank))


def alignment_variants(eps: Sequence[float], lambdas: Sequence[float], ledoit_wolf: bool = True) -> dict:
    """Settings of each rung's own regularisation axis."""
    coral = [{"alignment_eps": e, "ledoit_wolf": False} for e in eps]
    if ledoit_wolf:
        coral.append({"alignment_eps": None, "ledoit_wolf": True})
    lam = [{"alignment_lambda": v} for v in lambdas]
    return {"coral": coral, "mkmmd_diag": lam, "mkmmd_full": lam}


def blend_variants(rung: str, modes: Sequence[str], alphas: Sequence[float], n_groups: int) -> list[dict]:
    """(mode, alpha, groups) worth running for one rung: a no-op rung has one row only."""
    none = {"blending": "none"}
    if rung not in BLENDABLE:
        return [none]
    by_mode = {
        "none": [none],
        "scalar": [{"blending": "scalar", "blend_alpha": float(a)} for a in alphas],
        "gaa": [{"blending": "gaa", "n_groups": n_groups}],
    }
    return [v for m in modes for v in by_mode[m]]


def enumerate_grid(
    base: DataFrame, axes: Mapping[str, tuple[Sequence, str]],
    dependent: Sequence[tuple[str, Mapping, Mapping[str, str]]] = (), forbidden: Column | None = None,
) -> DataFrame:
    """Product of ``axes`` over the rows of ``base``, with per-axis variants.

    ``dependent`` entries are (axis, variants per value, field types). ``forbidden``
    marks combinations that do not exist.
    """
    out = base
    for name, (values, kind) in axes.items():
        out = out.withColumn(name, axis(values, kind))
    for column, table, fields in dependent:
        out = out.select("*", variants_by(column, table, fields).alias("_v")).select("*", "_v.*").drop("_v")
    return out if forbidden is None else out.where(~F.coalesce(forbidden, F.lit(False)))


def check_complete(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned cells without a completed row, and cells present more than once."""
    n = F.count(F.lit(1))
    have = done.groupBy(*keys).agg(n.alias("n"), F.count_if(F.col("status") != "ok").alias("n_bad"))
    cond = reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    j = plan.alias("p").join(have.alias("h"), cond, "left")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("n_bad") > 0, "failed")
    )
    return j.select(*[F.col(f"p.{k}").alias(k) for k in keys], problem.alias("problem")).where("problem IS NOT NULL")
