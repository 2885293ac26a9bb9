"""Class counts, priors and the divergences between them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.small import take_bounded

MAX_CORPORA = 1_000


def class_counts(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def priors(df: DataFrame, classes: Sequence[str], by: Sequence[str], label: str = "label") -> DataFrame:
    """P(class) over a fixed class list: an absent class is 0, a key without labels is null."""
    vec = prior_vector(df, classes, by, label)
    names = F.array(*[F.lit(c) for c in classes])
    each = vec.select(*by, F.posexplode(F.arrays_zip("counts", "p")).alias("pos", "z"))
    return each.select(*by, F.get(names, "pos").alias(label), F.col("z.counts").alias("n"), F.col("z.p").alias("prior"))


def prior_vector(
    df: DataFrame, classes: Sequence[str], by: Sequence[str], label: str = "label", weight: str | None = None
) -> DataFrame:
    """Prior of each key as an array in class order: K counters per key, one shuffle.

    With ``weight`` the rows are counts already (say, confusion counts).
    """
    hit = lambda c: F.col(label) == c
    if weight is None:
        counts = [F.count_if(hit(c)) for c in classes]
    else:
        counts = [F.coalesce(F.sum(F.when(hit(c), F.col(weight))), F.lit(0)).cast("long") for c in classes]
    agg = df.groupBy(*by).agg(F.array(*counts).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return agg.withColumn("total", total).withColumn(
        "p", F.transform("counts", lambda c: F.try_divide(c.cast("double"), F.col("total").cast("double")))
    )


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def kl_vec(p: Column, q: Column) -> Column:
    """KL(p || q) in nats; +inf as soon as p has mass where q has none."""
    terms = F.zip_with(
        p, q,
        lambda a, b: F.when(a <= 0, F.lit(0.0)).when(b <= 0, F.lit(math.inf)).otherwise(a * F.log(a / b)),
    )
    return _fold(terms)


def js_vec(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance: root of the mean KL to the midpoint."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2.0)
    return F.sqrt(F.greatest(F.lit(0.0), (kl_vec(p, mid) + kl_vec(q, mid)) / 2.0))


def clipped_kl_vec(target: Column, source: Column, floor: float = 1e-12) -> Column:
    """KL(target || source) with the source prior clipped away from zero."""
    terms = F.zip_with(
        target, source,
        lambda t, s: F.when(t <= 0, F.lit(0.0)).otherwise(t * F.log(t / F.greatest(s, F.lit(floor)))),
    )
    return _fold(terms)


def total_variation(p: Column, q: Column) -> Column:
    return _fold(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2.0


def unsupported(source: Column, target: Column, classes: Sequence[str]) -> Column:
    """Classes with target mass and no source mass: they cannot be trained."""
    names = F.array(*[F.lit(c) for c in classes])
    rows = F.arrays_zip(names.alias("c"), source.alias("s"), target.alias("t"))
    return F.transform(F.filter(rows, lambda r: (r["s"] <= 0) & (r["t"] > 0)), lambda r: r["c"])


def label_shift_columns(source: Column, target: Column, classes: Sequence[str]) -> list[Column]:
    kl = clipped_kl_vec(target, source)
    return [
        kl.alias("kl_nats"),
        (kl / F.lit(math.log(2.0))).alias("kl_bits"),
        total_variation(target, source).alias("total_variation"),
        unsupported(source, target, classes).alias("unsupported"),
    ]


def ordered_pairs(df: DataFrame, key: str, same: bool = False) -> DataFrame:
    """All ordered pairs of a corpus-level frame (one row per corpus), as s_* and t_* columns.

    The corpus list is folded into one array value and exploded, so the pairing is
    a projection over K rows rather than a join of two inputs. More rows than a list
    of corpora can have are refused: they would mean items were passed in.
    """
    cols = df.columns
    rows = take_bounded(df, MAX_CORPORA)
    if rows is None:
        raise ValueError(f"ordered_pairs expects one row per corpus, got more than {MAX_CORPORA}")
    packed = df.sparkSession.createDataFrame(rows, df.schema).agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in cols if c != key]))).alias("all"))
    left = packed.select(F.explode("all").alias("s"), "all")
    both = left.select("s", F.explode("all").alias("t"))
    if not same:
        both = both.where(F.col(f"s.{key}") != F.col(f"t.{key}"))
    out = [F.col(f"s.{c}").alias(f"s_{c}") for c in cols] + [F.col(f"t.{c}").alias(f"t_{c}") for c in cols]
    return both.select(*out)


def prior_shift_table(df: DataFrame, classes: Sequence[str], corpus: str, label: str = "label") -> DataFrame:
    """KL(source || target) and JS for every ordered corpus pair."""
    vec = prior_vector(df.where(F.col(label).isNotNull()), classes, [corpus], label).select(corpus, "total", "p")
    pairs = ordered_pairs(vec, corpus)
    return pairs.select(
        F.col(f"s_{corpus}").alias("source"), F.col(f"t_{corpus}").alias("target"),
        F.col("s_total").alias("n_source"), F.col("t_total").alias("n_target"),
        kl_vec(F.col("s_p"), F.col("t_p")).alias("kl"), js_vec(F.col("s_p"), F.col("t_p")).alias("js"),
    )


def drift(observed: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Rows whose value differs from a declared expectation by more than ``tol``."""
    e = expected.withColumnRenamed(value, "expected")
    return (
        observed.join(e, list(keys))
        .withColumn("drift", F.abs(F.col(value) - F.col("expected")))
        .withColumn("drifted", F.col("drift") > tol)
    )
