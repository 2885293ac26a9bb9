"""Ranks and order statistics that never put one hot group into one task.

A plain ``row_number().over(partitionBy(group))`` sorts a whole group in a single
task. Here a group is cut into ordered buckets first: bucket totals give each
bucket its offset, and only rows of one (group, bucket) meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise

# Spark pushes row_number() <= k below the shuffle only while k stays under
# spark.sql.optimizer.windowGroupLimitThreshold (default 1000).
GROUP_LIMIT_PUSHDOWN = 999

_HEX_BUCKET_DIGITS = 2  # 256 buckets: uniform, because the order key is a hash


def hash_rank(
    df: DataFrame, by: Sequence[str], hash_col: str, tie: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """1-based rank by ``hash_col`` (hex) inside ``by``; adds ``out`` and ``group_n``."""
    by = list(by)
    rows = df.withColumn("_b", F.substring(hash_col, 1, _HEX_BUCKET_DIGITS))
    ordered = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(ordered), F.lit(0)))
        .withColumn("group_n", F.sum("_c").over(W.partitionBy(*by)))
        .drop("_c")
    )
    inner = W.partitionBy(*by, "_b").orderBy(hash_col, *tie)
    return (
        rows.join(offsets, [*by, "_b"])
        .withColumn(out, F.col("_before") + F.row_number().over(inner))
        .drop("_b", "_before")
    )


def hash_top(
    df: DataFrame, by: Sequence[str], hash_col: str, k: int, tie: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` rows of each group with the smallest hash: a seeded sample without replacement."""
    if not by:
        return df.orderBy(hash_col, *tie).limit(k)
    if k <= GROUP_LIMIT_PUSHDOWN:
        w = W.partitionBy(*by).orderBy(hash_col, *tie)
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    ranked = hash_rank(df, by, hash_col, tie, out="_rn")
    return ranked.where(F.col("_rn") <= k).drop("_rn", "group_n")


def value_ranks(
    df: DataFrame, by: Sequence[str], value: str, buckets: int = 64
) -> DataFrame:
    """Distinct values per group with ``n`` (multiplicity), ``before`` (rows below), ``total``.

    Values are counted first, so ties collapse map side, and the counts are written once
    because three steps read them. Approximate quantiles of the distinct values only
    place the bucket edges; the ranks themselves are exact.
    """
    by = list(by)
    counted = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "values"
    )
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = counted.groupBy(*by).agg(
        F.percentile_approx(F.col(value).cast("double"), cuts, F.lit(1000)).alias("_edges"),
    )
    if by:
        keyed = counted.join(edges, by)
    else:
        # One group: its edges are one short array, taken as a literal.
        keyed = counted.withColumn("_edges", F.array(*[F.lit(e) for e in edges.first()["_edges"] or []]).cast("array<double>"))
    keyed = keyed.withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col(value).cast("double")))
    ).drop("_edges")
    ordered = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "_b")
        .agg(F.sum("n").alias("_c"))
        .withColumn("_off", F.coalesce(F.sum("_c").over(ordered), F.lit(0)))
        .withColumn("total", F.sum("_c").over(W.partitionBy(*by)))
        .drop("_c")
    )
    inner = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.join(offsets, [*by, "_b"])
        .withColumn("before", F.col("_off") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .select(*by, value, "n", "before", "total")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles of an unbounded column, one column per point."""
    ranked = value_ranks(df, by, value)
    aggs: list[Column] = [F.max("total").alias("n")]
    v = F.col(value).cast("double")
    for name, q in points.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("before") <= idx) & (idx < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, v)).alias(f"_{name}_{tag}"))
    out = ranked.groupBy(*by).agg(*aggs)
    cols: list[Column] = [F.col(c) for c in by] + [F.col("n")]
    for name, q in points.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*cols)


def best_by(df: DataFrame, by: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """The best-scored row per group; ``order`` decides ties. Rows without a score cannot win.

    The rank filter is pushed below the shuffle, so a map task sends at most one
    row per group however large the group is.
    """
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), *order)
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def holm(df: DataFrame, p: str, by: Sequence[str] = (), order: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Holm-Bonferroni step-down over each family; adds ``holm`` and ``reject``.

    The input is one row per contrast. A family is a declared list of contrasts, so
    its window is small by construction.
    """
    m = F.count(F.lit(1)).over(W.partitionBy(*by))
    step = W.partitionBy(*by).orderBy(p, *order)
    rn = F.row_number().over(step)
    return (
        df.withColumn("_scaled", (m - rn + 1) * F.col(p))
        .withColumn(
            "holm",
            F.least(F.lit(1.0), F.max("_scaled").over(step.rowsBetween(W.unboundedPreceding, 0))),
        )
        .withColumn("reject", F.col("holm") <= F.lit(alpha))
        .drop("_scaled")
    )


def tolerant_rank(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[str] = (),
    rel: float = 0.01, floor: float = 1e-9, out: str = "rank",
) -> DataFrame:
    """Rank in ascending order where a value within ``rel`` of its predecessor shares its rank."""
    w = W.partitionBy(*by).orderBy(value, *order)
    prev = F.lag(value).over(w)
    opens = prev.isNull() | (
        F.abs(F.col(value) - prev) > F.greatest(F.lit(floor), F.abs(prev) * F.lit(rel))
    )
    return (
        df.withColumn("_start", F.when(opens, F.row_number().over(w)))
        .withColumn(out, F.last("_start", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_start")
    )


def spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, order: Sequence[str], min_cells: int = 3
) -> DataFrame:
    """Rank correlation with ordinal ranks: ties fall in ``order``, they are not averaged.

    Null below ``min_cells``. One row per axis cell is expected, so a group holds a
    grid axis, not items.
    """
    rx = F.row_number().over(W.partitionBy(*by).orderBy(x, *order)).cast("double")
    ry = F.row_number().over(W.partitionBy(*by).orderBy(y, *order)).cast("double")
    ranked = df.withColumn("_rx", rx).withColumn("_ry", ry)
    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(
        n.alias("n"), F.when(n >= min_cells, F.corr("_rx", "_ry")).alias("rho")
    )


def ordered_rank(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], out: str = "rank"
) -> DataFrame:
    """1-based rank by ``order`` inside ``by``; ``bucket`` must grow with the order (say, the hour).

    Adds ``out`` and ``group_n``. Rows of one (by, bucket) meet in a task, not all of ``by``.
    """
    by = list(by)
    rows = df.withColumn("_b", bucket)
    ordered = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(ordered), F.lit(0)))
        .withColumn("group_n", F.sum("_c").over(W.partitionBy(*by)))
        .drop("_c")
    )
    inner = W.partitionBy(*by, "_b").orderBy(*order)
    return (
        rows.join(offsets, [*by, "_b"])
        .withColumn(out, F.col("_before") + F.row_number().over(inner))
        .drop("_b", "_before")
    )
