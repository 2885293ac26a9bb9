"""Chance floors: what a predictor without information would score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw_hash, draw_index, draw_uniform
from ..functions.small import spread
from .metrics import confusion_counts, macro_f1


def uniform_floor(p: Column, k: int) -> Column:
    """Uniform random predictor: F1 of class i is 2 p_i q / (p_i + q) with q = 1/K."""
    q = 1.0 / k
    return F.aggregate(F.transform(p, lambda x: 2.0 * x * q / (x + q)), F.lit(0.0), lambda a, x: a + x) / k


def majority_floor(p: Column, index: Column, k: int) -> Column:
    """Constant predictor: only the predicted class scores."""
    pm = F.get(p, index)
    return 2.0 * pm / (pm + 1.0) / k


def prior_floor(p: Column, q: Column, k: int) -> Column:
    """Predictions drawn from the source prior."""
    f1 = F.zip_with(p, q, lambda a, b: F.coalesce(F.try_divide(2.0 * a * b, a + b), F.lit(0.0)))
    return F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / k


def majority_index(counts: Column, tie: str = "last") -> Column:
    """0-based class of the largest count.

    ``tie='last'`` gives the largest class name, the rule of the floor table;
    ``tie='first'`` gives the first class, the rule of the per-run columns.
    """
    top = F.array_max(counts)
    if tie == "first":
        return (F.array_position(counts, top) - 1).cast("int")
    return (F.size(counts) - F.array_position(F.reverse(counts), top)).cast("int")


def analytic_floors(target: DataFrame, source: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Closed forms per key. Both inputs carry ``counts`` and ``p`` arrays in class order."""
    t = target.select(*keys, F.col("p").alias("tp"))
    s = source.select(*keys, F.col("counts").alias("sc"), F.col("p").alias("sp"))
    return t.join(s, list(keys)).select(
        *keys,
        uniform_floor(F.col("tp"), k).alias("chance_macro_f1"),
        majority_floor(F.col("tp"), majority_index(F.col("sc")), k).alias("majority_macro_f1"),
        prior_floor(F.col("tp"), F.col("sp"), k).alias("prior_matched_macro_f1"),
    )


def with_draws(df: DataFrame, reps: int, seed: int, item: str) -> DataFrame:
    """Each row once per repetition with its own hash draw ``h``. Rows never leave their task.

    The hash is made inside the exploded array: as a plain column the optimizer would
    inline it into every use, once per element of a class list.
    """
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.struct(r.alias("rep"), draw_hash(seed, r, F.col(item)).alias("h"))
    )
    return spread(df).withColumn("_d", F.explode(draws)).select("*", "_d.rep", "_d.h").drop("_d")


def uniform_prediction(classes: Sequence[str]) -> Column:
    """A predictor over the draw column: every class equally likely."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.get(names, draw_index(F.col("h"), len(classes)).cast("int"))


def prior_prediction(classes: Sequence[str], cumulative: str) -> Column:
    """A predictor over the draw column and a cumulative source prior (array column)."""
    names = F.array(*[F.lit(c) for c in classes])
    below = F.size(F.filter(F.col(cumulative), lambda c: c <= draw_uniform(F.col("h"))))
    return F.get(names, F.least(below, F.lit(len(classes) - 1)).cast("int"))


def cumulative(p: Column) -> Column:
    """Running sums of a prior, left to right."""
    def step(acc, x):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
        return F.concat(acc, F.array(last + x))

    return F.aggregate(p, F.array().cast("array<double>"), step)


def empirical_floor(
    df: DataFrame, classes: Sequence[str], by: Sequence[str], predictor: Column,
    item: str, reps: int, seed: int = 0, level: float = 0.95,
) -> DataFrame:
    """Item-level floor: any predictor expression over ``h``; mean and interval over draws."""
    drawn = with_draws(df, reps, seed, item).withColumn("y_pred", predictor)
    scores = macro_f1(confusion_counts(drawn, [*by, "rep"]), classes, [*by, "rep"])
    a = (1.0 - level) / 2.0
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.avg("macro_f1").alias("mean"),
        F.percentile("macro_f1", a).alias("lo"),
        F.percentile("macro_f1", 1.0 - a).alias("hi"),
    )


def multinomial_floor(
    truth: DataFrame, by: Sequence[str], reps: int, seed: int = 0, level: float = 0.95,
    q: str | None = None, shards: int = 16,
) -> DataFrame:
    """The same floor from class counts alone, at a cost independent of the number of items.

    ``truth`` has one row per key with ``counts`` (K longs) and, for the prior-matched
    floor, an array column ``q``. Drawing n_i predictions for class i is one
    multinomial, so the repetitions are spread over ``shards`` rows per key.
    """
    keys = list(by)
    per = -(-reps // shards)
    work = truth.select(*keys, "counts", *( [q] if q else [] )).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ).repartition(*keys, "shard")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in truth.select(*keys).schema)
    schema = f"{fields}, rep int, score double" if keys else "rep int, score double"

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = np.asarray(row["counts"], dtype=np.int64)
                k = len(n)
                prior = np.asarray(row[q], dtype=float) if q else np.full(k, 1.0 / k)
                first = int(row["shard"]) * per
                m = max(0, min(reps, first + per) - first)
                if m == 0:
                    continue
                rng = np.random.default_rng([seed, int(row["shard"])])
                conf = np.stack([rng.multinomial(c, prior, size=m) for c in n], axis=1)
                tp = np.einsum("rii->ri", conf)
                den = n[None, :] + conf.sum(axis=1)
                f1 = np.where(den > 0, 2.0 * tp / np.maximum(den, 1), 0.0).mean(axis=1)
                out = {c: [row[c]] * m for c in keys}
                out["rep"] = np.arange(first, first + m, dtype=np.int32)
                out["score"] = f1
                yield pd.DataFrame(out)

    a = (1.0 - level) / 2.0
    return work.mapInPandas(run, schema).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg("score").alias("mean"),
        F.percentile("score", a).alias("lo"), F.percentile("score", 1.0 - a).alias("hi"),
    )
