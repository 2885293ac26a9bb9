"""Pairing runs that differ in one coordinate, and checks that the pairing is whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lookup join. Ids without a partner are reported by :func:`missing_keys`."""
    return df.join(dim, list(key))


def missing_keys(df: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(dim.select(*key), list(key), "left_anti").select(*key).distinct()


def join_annotations(media: DataFrame, notes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Media with their annotation, and the problems: missing or repeated annotations."""
    folded = notes.groupBy(key).agg(
        F.min("raw").alias("raw"), F.count(F.lit(1)).alias("_n"), F.max("raw").alias("_other")
    )
    j = media.join(folded, key, "left")
    problem = (
        F.when(F.col("_n").isNull(), "no annotation")
        .when(F.col("raw") != F.col("_other"), "contradictory")
        .when(F.col("_n") > 1, "repeated")
    )
    bad = j.select(key, problem.alias("problem")).where("problem IS NOT NULL")
    good = j.where("_n = 1").drop("_n", "_other")
    return good, bad


def _pick(axis: str, value: str, score: str, order: Sequence[str], columns: Sequence[str]) -> Column:
    """Best row of one side inside a group: highest score, then first in ``order``."""
    rank = F.when(F.col(axis) == value, F.struct(-F.col(score), *order))
    return F.min_by(F.struct(*columns), rank)


def paired_arms(
    ledger: DataFrame, axis: str, a: str, b: str, cond: Sequence[str], score: str,
    order: Sequence[str], columns: Sequence[str],
) -> DataFrame:
    """Best run of each side per condition, conditions with both sides only.

    Both sides are picked in the same aggregation, so the pairing costs one shuffle
    and no self join; the map side already keeps one candidate per side and condition.
    """
    rows = ledger.where(F.col(axis).isin(a, b) & F.col(score).isNotNull())
    g = rows.groupBy(*cond).agg(
        _pick(axis, a, score, order, columns).alias("a"), _pick(axis, b, score, order, columns).alias("b")
    )
    both = g.where("a IS NOT NULL AND b IS NOT NULL")
    return both.select(
        *cond, *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns],
        *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns],
    )


def match_arms(
    ledger: DataFrame, keys: Sequence[str], axis: str, a: str, b: str, columns: Sequence[str]
) -> DataFrame:
    """Strict pairing on exact keys (nulls are key values), with the evidence to refuse it.

    Group-by treats null keys as equal, as a null-safe join would. ``problem`` is null
    only for a cell with exactly one completed, finite run on each side.
    """
    rows = ledger.where(F.col(axis).isin(a, b))
    val, test = F.col("val"), F.col("test")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    is_a, is_b = F.col(axis) == a, F.col(axis) == b
    pick = lambda side: F.min_by(F.struct(*columns), F.when(side, F.col("run_id")))
    g = rows.groupBy(*keys).agg(
        F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"),
        F.count_if(F.col("status") != "ok").alias("n_failed"),
        F.count_if((F.col("status") == "ok") & ~(finite(val) & finite(test))).alias("n_nonfinite"),
        pick(is_a).alias("a"), pick(is_b).alias("b"),
    )
    problem = (
        F.when(F.col("n_failed") > 0, "incomplete")
        .when((F.col("n_a") == 0) | (F.col("n_b") == 0), "missing arm")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate arm")
        .when(F.col("n_nonfinite") > 0, "non-finite score")
    )
    return g.select(
        *keys, "n_a", "n_b", problem.alias("problem"),
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns],
    )


def equality_flags(matched: DataFrame, params: str = "$.selected") -> DataFrame:
    """Clean pairs with exact-equality flags on score and selected parameters."""
    pa = F.get_json_object("a_hyperparams_json", params)
    pb = F.get_json_object("b_hyperparams_json", params)
    return matched.where("problem IS NULL").withColumn(
        "validation_equal", F.col("a_val") == F.col("b_val")
    ).withColumn("params_equal", pa.eqNullSafe(pb)).withColumn(
        "target_difference", F.col("b_test") - F.col("a_test")
    )


def audit_summary(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    both = F.col("validation_equal") & F.col("params_equal")
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if("validation_equal").alias("n_score_equal"),
        F.count_if("params_equal").alias("n_params_equal"),
        F.count_if(both).alias("n_both_equal"),
        F.count_if(F.col("target_difference") > 0).alias("n_positive"),
        F.avg("target_difference").alias("mean_difference"),
    )


def match_trials(runs: DataFrame, trials: DataFrame, keys: Sequence[str], axis: str, a: str, b: str) -> DataFrame:
    """Candidate by candidate comparison of two arms of each cell.

    Arms meet in one group-by on (cell, candidate); a candidate seen on one side only,
    twice, or with other parameters voids the cell and is counted.
    """
    arm = runs.where(F.col(axis).isin(a, b)).select("run_id", axis, *keys)
    t = trials.join(arm, "run_id")
    side_a = F.col(axis) == a
    one = lambda c, s: F.max(F.when(s, F.col(c)))
    fields = ("params_json", "prediction_digest", "decision_digest", "score")
    g = t.groupBy(*keys, "candidate_index").agg(
        F.count_if(side_a).alias("na"), F.count_if(~side_a).alias("nb"),
        *[one(c, side_a).alias(f"{c}_a") for c in fields], *[one(c, ~side_a).alias(f"{c}_b") for c in fields],
    )
    eq = lambda c: F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    whole = (F.col("na") == 1) & (F.col("nb") == 1)
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~whole | ~eq("params_json")).alias("n_unmatched"),
        F.count_if(whole & eq("prediction_digest")).alias("n_prediction_equal"),
        F.count_if(whole & eq("score")).alias("n_score_equal"),
        F.count_if(whole & eq("decision_digest")).alias("n_decision_equal"),
    )


def matched_pool(ref: DataFrame, probe: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reference rows whose every axis value occurs somewhere in the probe.

    The axes are independent sets, not one joint key: one semi join per axis, each
    against the axis' distinct values.
    """
    out = ref
    for c in columns:
        out = out.join(probe.select(c).distinct(), c, "left_semi")
    return out


def vs_baseline(df: DataFrame, axis: str, base: str, keys: Sequence[str], value: str) -> DataFrame:
    """Each variant minus the declared baseline per key; keys on one side only are flagged."""
    rows = df.groupBy(*keys, axis).agg(F.avg(value).alias("v"))
    b = rows.where(F.col(axis) == base).select(*keys, F.col("v").alias("base_value"))
    other = rows.where(F.col(axis) != base)
    j = other.join(b, list(keys), "full_outer")
    return j.select(
        *keys, axis, (F.col("v") - F.col("base_value")).alias("difference"),
        F.when(F.col("v").isNull(), "baseline only").when(F.col("base_value").isNull(), "variant only").alias("problem"),
    )
