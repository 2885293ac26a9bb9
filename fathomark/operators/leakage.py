"""Split checks. Each returns violation rows; a clean split returns none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import ROLES


class LeakageError(AssertionError):
    """A split check found violations."""


def _rows(df: DataFrame, kind: str, subject) -> DataFrame:
    return df.select("split_id", F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))


def _group_roles(rows: DataFrame) -> DataFrame:
    """First and last role and the items per role of each (split, corpus, group).

    Both group-level checks start from this aggregate, so its shuffle is shared.
    """
    per_role = [F.count_if(F.col("role") == r) for r in ROLES]
    return rows.groupBy("split_id", "corpus", "grp").agg(
        F.min("role").alias("a"), F.max("role").alias("b"), F.array(*per_role).alias("c")
    )


def group_in_two_roles(rows: DataFrame) -> DataFrame:
    g = _group_roles(rows)
    return _rows(g.where("a < b"), "group_in_two_roles", F.concat_ws("/", "corpus", F.col("grp").cast("string")))


def item_on_both_sides(rows: DataFrame) -> DataFrame:
    side = F.col("role").isin(ROLES[0], ROLES[1]).cast("int")
    g = rows.groupBy("split_id", "item_id").agg(F.min(side).alias("a"), F.max(side).alias("b"))
    return _rows(g.where("a < b"), "item_on_both_sides", F.col("item_id"))


def empty_role(rows: DataFrame) -> DataFrame:
    sums = F.array(*[F.sum(F.col("c")[i]) for i in range(len(ROLES))])
    missing = _group_roles(rows).groupBy("split_id").agg(sums.alias("c")).select(
        "split_id", F.posexplode("c").alias("pos", "n")
    ).where("n = 0")
    return _rows(missing, "empty_role", F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("pos")))


def bad_fit_ids(rows: DataFrame, fit_ids: DataFrame) -> DataFrame:
    """Ids a fitted map saw that are held out, or belong to no role of the split."""
    # Roles are folded per item first so that an item in several roles is judged once.
    roles = rows.groupBy("split_id", "item_id").agg(
        F.max((F.col("role") == ROLES[3]).cast("int")).alias("held"),
        F.max((F.col("role") != ROLES[3]).cast("int")).alias("open"),
    )
    j = fit_ids.select("split_id", "item_id").distinct().join(roles, ["split_id", "item_id"], "left")
    kind = F.when(F.col("held") == 1, "fit_on_held_out").when(F.col("open").isNull(), "fit_outside_split")
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "split_id", "kind", F.col("item_id").cast("string").alias("subject")
    )


def leakage(rows: DataFrame, fit_ids: DataFrame | None = None) -> DataFrame:
    """Every violation of every kind in one frame."""
    out = group_in_two_roles(rows).unionByName(item_on_both_sides(rows)).unionByName(empty_role(rows))
    return out if fit_ids is None else out.unionByName(bad_fit_ids(rows, fit_ids))


def assert_clean(violations: DataFrame, sample: int = 5) -> None:
    """Raise with a few offenders when there is any violation."""
    bad = offenders(violations, ["split_id", "kind", "subject"], sample).collect()
    if bad:
        raise LeakageError("; ".join(f"{r.split_id}: {r.kind} {r.subject}" for r in bad))


def offenders(df: DataFrame, order, n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order, for an error message."""
    return df.orderBy(*order).limit(n)


def unassigned(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Labelled items that landed in no role."""
    return items.where("label IS NOT NULL").join(rows.select("item_id").distinct(), "item_id", "left_anti")
