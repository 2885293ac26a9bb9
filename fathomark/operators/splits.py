"""Group-disjoint splits for every corpus, pair and seed at once, in long form.

Groups are ordered by a hash of (seed, label, group), so a split is a function of
its inputs: the same on any cluster, and independent of which pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw_hash
from ..functions.small import small_side
from ..sources.scratch import materialise
from .ranking import hash_rank

MAX_BROADCAST_GROUPS = 500_000

ROLES = ("source_train", "source_val", "target_adapt", "target_test")


def group_key(session_corpora: Sequence[str] = ("iemocap",)) -> Column:
    """Session where it is the standard unit of a corpus, else (or if empty) the speaker."""
    use = F.lower("corpus").isin(list(session_corpora)) & (F.coalesce("session_id", F.lit("")) != "")
    return F.when(use, F.col("session_id")).otherwise(F.col("speaker_id"))


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def too_few_groups(items: DataFrame, minimum: int = 2) -> DataFrame:
    """Corpora that cannot be split at all."""
    groups = items.where("label IS NOT NULL").select("corpus", "grp").distinct()
    return groups.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_groups")).where(
        F.col("n_groups") < minimum
    )


def partition_groups(groups: DataFrame, by: Sequence[str], ratio: float, parts: Sequence) -> DataFrame:
    """Adds ``first``: the seeded share of groups, at least one group on each side.

    ``groups`` is distinct on (by, grp). The cut uses banker's rounding.
    """
    h = draw_hash(*parts, F.col("grp"))
    ranked = hash_rank(groups.withColumn("_h", h), by, "_h", ["grp"], out="_rank")
    cut = F.greatest(F.lit(1), F.least(F.col("group_n") - 1, F.bround(F.col("group_n") * F.lit(ratio), 0)))
    return ranked.withColumn("first", F.col("_rank") <= cut).drop("_h", "_rank", "group_n")


def _side_groups(items: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return with_seeds(items.where("label IS NOT NULL").select("corpus", "grp").distinct(), seeds)


def side_assignments(
    items: DataFrame, seeds: Sequence[int], train_ratio: float = 0.8, adapt_ratio: float = 0.5
) -> DataFrame:
    """(corpus, seed, grp, role) for the source side and the target side of every corpus.

    A cross-corpus split joins the source side of one corpus to the target side of
    another, and neither depends on its partner, so pairs cost nothing here.
    """
    groups = _side_groups(items, seeds).withColumn(
        "side", F.explode(F.array(F.lit("source"), F.lit("target")))
    )
    h = draw_hash(F.col("seed"), F.col("corpus"), F.col("side"), F.col("grp"))
    ranked = hash_rank(groups.withColumn("_h", h), ["corpus", "seed", "side"], "_h", ["grp"], "_rank")
    source = F.col("side") == "source"
    n = F.col("group_n")
    ratio = F.when(source, F.lit(train_ratio)).otherwise(F.lit(adapt_ratio))
    first = F.col("_rank") <= F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio, 0)))
    role = (
        F.when(source & first, ROLES[0]).when(source, ROLES[1]).when(first, ROLES[2]).otherwise(ROLES[3])
    )
    return ranked.select("corpus", "seed", "grp", role.alias("role"))


def in_domain_assignments(
    items: DataFrame, seeds: Sequence[int], source_ratio: float = 0.5,
    train_ratio: float = 0.8, adapt_ratio: float = 0.5,
) -> DataFrame:
    """One corpus cut four disjoint ways: first into sides, then each side into its roles."""
    keys = ["corpus", "seed"]
    sides = partition_groups(
        _side_groups(items, seeds), keys, source_ratio, [F.col("seed"), F.col("corpus"), "in_domain"]
    ).withColumn("side", F.when(F.col("first"), "source").otherwise("target")).drop("first")
    label = F.concat(F.lit("in_domain_"), F.col("side"))
    h = draw_hash(F.col("seed"), F.col("corpus"), label, F.col("grp"))
    ranked = hash_rank(sides.withColumn("_h", h), [*keys, "side"], "_h", ["grp"], "_rank")
    source = F.col("side") == "source"
    n = F.col("group_n")
    ratio = F.when(source, F.lit(train_ratio)).otherwise(F.lit(adapt_ratio))
    first = F.col("_rank") <= F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio, 0)))
    role = (
        F.when(source & first, ROLES[0]).when(source, ROLES[1]).when(first, ROLES[2]).otherwise(ROLES[3])
    )
    return ranked.select("corpus", "seed", "grp", role.alias("role"))


def assign_roles(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """Items with a label, once per (seed, role) of their group.

    The assignment table holds groups, not items. It is written once and counted: small
    enough, it is broadcast and the items are not shuffled; otherwise both sides shuffle
    and adaptive execution splits a group that holds too many items.
    """
    table = materialise(assignments, "assignments")
    if table.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        table = F.broadcast(table)
    return items.where("label IS NOT NULL").join(table, ["corpus", "grp"])


def pair_rows(rows: DataFrame, corpora: Sequence[str]) -> DataFrame:
    """Role rows as pair rows: each side is repeated once per partner corpus."""
    partner = F.explode(F.array(*[F.lit(c) for c in corpora]))
    is_source = F.col("role").isin(ROLES[0], ROLES[1])
    return (
        rows.withColumn("_p", partner)
        .where(F.col("_p") != F.col("corpus"))
        .withColumn("source", F.when(is_source, F.col("corpus")).otherwise(F.col("_p")))
        .withColumn("target", F.when(is_source, F.col("_p")).otherwise(F.col("corpus")))
        .withColumn("split_id", F.concat(F.col("source"), F.lit("-"), F.col("target"), F.lit("-s"), F.col("seed")))
        .drop("_p")
    )


def pair_split(items: DataFrame, corpora: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Four-role split rows of every ordered pair of distinct corpora."""
    return pair_rows(assign_roles(items, side_assignments(items, seeds)), corpora)


def quota(counts: DataFrame, by: Sequence[str], name: str, cap: str) -> DataFrame:
    """Largest-remainder share of ``cap`` for each ``name``; one row per class expected."""
    total = F.sum("n").over(W.partitionBy(*by))
    exact = (F.col("n") * F.col(cap)).cast("double") / total
    d = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.col(cap) - F.sum("_floor").over(W.partitionBy(*by))
    place = F.row_number().over(
        W.partitionBy(*by).orderBy((F.col("_exact") - F.col("_floor")).desc(), name)
    )
    return d.withColumn(
        "quota", F.col("_floor") + F.when(place <= left, F.lit(1)).otherwise(F.lit(0))
    ).drop("_exact", "_floor")


def stratified_cap(
    rows: DataFrame, by: Sequence[str], caps: DataFrame, parts: Sequence, label: str = "label",
    item: str = "item_id",
) -> DataFrame:
    """Keep ``cap`` rows per ``by`` with class shares preserved; ``caps`` has by + cap."""
    by = list(by)
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).join(caps, by)
    quotas = quota(counts, by, label, "cap").select(*by, label, "quota")
    h = draw_hash(*parts, F.col(item))
    ranked = hash_rank(rows.withColumn("_h", h), [*by, label], "_h", [item], "_rank")
    return (
        ranked.join(small_side(quotas), [*by, label])
        .where(F.col("_rank") <= F.col("quota"))
        .drop("_h", "_rank", "group_n", "quota")
    )


def matched_caps(rows: DataFrame) -> DataFrame:
    """The smaller source_train size of a pair's two directions, for the larger direction only."""
    sizes = rows.where(F.col("role") == ROLES[0]).groupBy("source", "target", "seed").agg(
        F.count(F.lit(1)).alias("n")
    )
    pair = [F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")]
    keyed = sizes.select("*", *pair)
    cap = F.min("n").over(W.partitionBy("_a", "_b", "seed"))
    return keyed.withColumn("cap", cap).select("source", "target", "seed", "n", "cap")


def match_n(rows: DataFrame) -> DataFrame:
    """source_train of both directions at equal size; the other roles are unchanged."""
    caps = matched_caps(rows)
    keys = ["source", "target", "seed"]
    train = rows.where(F.col("role") == ROLES[0])
    kept = stratified_cap(
        train, keys, caps.select(*keys, "cap"),
        [F.col("seed"), F.col("source"), F.col("target"), "matched_source_train"],
    )
    rest = rows.where(F.col("role") != ROLES[0])
    return kept.unionByName(rest)


def split_summary(rows: DataFrame) -> DataFrame:
    """Items and groups per pair, seed and role.

    Groups are counted by collapsing to (.., grp) first, so the hot pair of a
    distinct count is spread over its groups.
    """
    keys = ["source", "target", "seed", "role"]
    per_group = rows.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy(*keys).agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_groups")
    )


def coverage_split(items: DataFrame, ratio: float, offsets: int = 64) -> DataFrame:
    """Two-way group split that retries seeds until the test side covers every label.

    All offsets are evaluated in one pass over (grp, label) counts; the first
    covering offset wins, else the one that covers most labels.
    """
    cells = items.where("label IS NOT NULL").groupBy("corpus", "grp", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = with_seeds(cells.select("corpus", "grp").distinct(), range(offsets))
    parts = partition_groups(groups, ["corpus", "seed"], ratio, [F.col("seed"), F.col("corpus"), "coverage"])
    covered = (
        parts.where(~F.col("first")).join(cells.select("corpus", "grp", "label"), ["corpus", "grp"])
        .groupBy("corpus", "seed", "label").agg(F.lit(1).alias("one"))
        .groupBy("corpus", "seed").agg(F.count(F.lit(1)).alias("n_labels"))
    )
    pick = covered.groupBy("corpus").agg(F.min_by("seed", F.struct(-F.col("n_labels"), "seed")).alias("seed"))
    return parts.join(pick, ["corpus", "seed"], "left_semi").select(
        "corpus", "seed", "grp", F.when(F.col("first"), "train").otherwise("test").alias("role")
    )
