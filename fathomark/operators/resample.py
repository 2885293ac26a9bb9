"""Bootstrap over groups and seeds, paired arms, item bootstrap and signed ranks.

Predictions enter as packed confusions: one K*K count array per (seed, condition,
group) and arm, written once to the shared folder because every step reads them. A replicate is a weighted sum of those arrays, so no replicate
ever scans an item. Each group row makes its own draws, which spreads the work
over the groups without a cross product of inputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw_hash, draw_index
from ..functions.small import broadcast_checked, small_side, spread
from ..sources.scratch import materialise
from .metrics import confusion_counts
from .ranking import exact_quantiles, hash_rank, value_ranks


# ---- packed input ----------------------------------------------------------
def pack_arms(df: DataFrame, classes: Sequence[str], by: Sequence[str], arm: str, arms: Sequence[str]) -> DataFrame:
    """One row per (by, seed, cond, grp) with an array of K*K counts for each arm.

    All cells of all arms are counters of one aggregation over the predictions.
    """
    cells = []
    for name in arms:
        one = [
            F.count_if((F.col(arm) == name) & (F.col("y_true") == t) & (F.col("y_pred") == p))
            for t in classes for p in classes
        ]
        cells.append(F.array(*one).alias(name))
    return df.groupBy(*by, "seed", "cond", "grp").agg(*cells)


def index_groups(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, seed, grp, idx, group_n): a dense 0-based index of the groups of each seed of each key."""
    g = packed.select(*by, "seed", "grp").distinct()
    h = draw_hash(F.col("seed"), F.col("grp"))
    ranked = hash_rank(g.withColumn("_h", h), [*by, "seed"], "_h", ["grp"], "_r")
    return ranked.select(*by, "seed", "grp", (F.col("_r") - 1).alias("idx"), "group_n")


def group_draws(groups: DataFrame, reps: int, salt: str = "boot", by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, seed, idx): as many draws with replacement as the key's seed has groups.

    The draws of a seed do not depend on the key, so keys with the same groups draw the same ones.
    """
    each = spread(groups).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    h = draw_hash(salt, F.col("rep"), F.col("seed"), F.col("idx"))
    return each.select(*by, "rep", "seed", draw_index(h, F.col("group_n")).alias("idx"))


def seed_draws(groups: DataFrame, reps: int, salt: str = "seed", by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, pos, seed, n_seeds): the seeds of each key drawn with replacement. Rows: reps x seeds."""
    seeds = groups.select(*by, "seed").distinct().groupBy(*by).agg(F.array_sort(F.collect_list("seed")).alias("seeds"))
    n = F.size("seeds")
    each = seeds.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), n - 1))
    )
    h = draw_hash(salt, F.col("rep"), F.col("pos"))
    pick = F.get("seeds", draw_index(h, n).cast("int"))
    return each.select(*by, "rep", "pos", pick.alias("seed"), n.alias("n_seeds"))


# ---- scores of packed cells ------------------------------------------------
def cell_sums(arm: str, k: int) -> list[Column]:
    return [F.sum(F.col(arm)[i]).alias(f"{arm}_{i}") for i in range(k * k)]


def _margins(arm: str, k: int, i: int) -> tuple[Column, Column, Column]:
    at = lambda r, c: F.col(f"{arm}_{r * k + c}")
    support = sum((at(i, c) for c in range(1, k)), at(i, 0))
    predicted = sum((at(r, i) for r in range(1, k)), at(0, i))
    return at(i, i), support, predicted


def class_scores(arm: str, k: int, i: int) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of class ``i``; F1 is null for a class absent on both sides."""
    tp, sup, pre = _margins(arm, k, i)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(ratio(tp, pre), F.lit(0.0)), F.coalesce(ratio(tp, sup), F.lit(0.0)), ratio(2 * tp, sup + pre)


def macro_f1_cells(arm: str, k: int) -> Column:
    """Mean F1 over classes present in truth or prediction."""
    f1 = F.array(*[class_scores(arm, k, i)[2] for i in range(k)])
    seen = F.array_compact(f1)
    return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x), F.size(seen).cast("double"))


# ---- cluster bootstrap -----------------------------------------------------
def _per_seed(sums: DataFrame, keys: Sequence[str], arms: Sequence[str], k: int) -> DataFrame:
    scored = sums.select(*keys, *[macro_f1_cells(a, k).alias(f"s_{a}") for a in arms])
    seed_keys = [c for c in keys if c != "cond"]
    return scored.groupBy(*seed_keys).agg(*[F.avg(f"s_{a}").alias(f"s_{a}") for a in arms])


def replicates(packed: DataFrame, arms: Sequence[str], k: int, by: Sequence[str], reps: int, salt: str = "boot") -> DataFrame:
    """(by, rep, s_arm...): each arm's score on the same resampled seeds and groups.

    One group draw per (key, replicate, seed) is shared by all arms and reused when the
    seed is drawn twice; conditions average inside a seed, then seeds average. Every key
    resamples its own seeds and groups, whatever other keys hold.
    """
    by = list(by)
    groups = materialise(index_groups(packed, by), "groups")
    sums = group_draws(groups, reps, salt, by).join(_indexed_cells(packed, groups, by), [*by, "seed", "idx"]).groupBy(
        *by, "rep", "seed", "cond"
    ).agg(*[c for a in arms for c in cell_sums(a, k)])
    return _over_seeds(sums, groups, arms, k, by, reps)


def _indexed_cells(packed: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packed cells under their group index. Small ones go to the draws; otherwise both sides
    shuffle on (key, seed, idx), which is uniform whatever the groups hold."""
    return broadcast_checked(packed.join(groups.select(*by, "seed", "grp", "idx"), [*by, "seed", "grp"]).drop("grp"))


def _over_seeds(sums: DataFrame, groups: DataFrame, arms: Sequence[str], k: int, by: Sequence[str], reps: int) -> DataFrame:
    """Cell sums per (replicate, seed, condition) scored and averaged over the drawn seeds."""
    per = _per_seed(sums, [*by, "rep", "seed", "cond"], arms, k)
    drawn = seed_draws(groups, reps, by=by).groupBy(*by, "rep", "seed").agg(
        F.count(F.lit(1)).alias("m"), F.max("n_seeds").alias("n_seeds")
    )
    w = F.col("m") / F.col("n_seeds")
    return per.join(drawn, [*by, "rep", "seed"]).groupBy(*by, "rep").agg(
        *[F.sum(w * F.col(f"s_{a}")).alias(f"s_{a}") for a in arms]
    )


def block_replicates(
    packed: DataFrame, arms: Sequence[str], k: int, by: Sequence[str], reps: int, salt: str = "boot", blocks: int = 64
) -> DataFrame:
    """:func:`replicates` for many replicates: the weighted sums run as matrix products.

    A group's draws arrive as the list of replicates that drew it, so a block of groups
    is one (replicates x groups) by (groups x cells) product in its task; blocks then add
    up in Spark. Same draws, same numbers, about B times fewer rows after the join.
    """
    by = list(by)
    groups = materialise(index_groups(packed, by), "groups")
    # A group is drawn about ``reps`` times in all, so its list is bounded by the parameter.
    lists = group_draws(groups, reps, salt, by).groupBy(*by, "seed", "idx").agg(F.collect_list("rep").alias("drawn"))
    cells = _indexed_cells(packed, groups, by)
    wide = F.concat(*[F.col(a) for a in arms])
    rows = lists.join(cells, [*by, "seed", "idx"]).select(
        *by, "seed", "cond", F.pmod("idx", F.lit(blocks)).alias("block"), "drawn", wide.alias("cells")
    )
    keys = [*by, "seed", "cond"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    n_cells = len(arms) * k * k

    def multiply(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                w = np.zeros((reps, len(part)))
                for j, drawn in enumerate(part["drawn"]):
                    np.add.at(w[:, j], np.asarray(drawn), 1.0)
                c = np.stack(part["cells"].to_numpy()).astype(float)
                acc = total.setdefault(key, np.zeros((reps, n_cells)))
                acc += w @ c
        for key, acc in total.items():
            out = {name: [v] * reps for name, v in zip(keys, key)}
            out["rep"] = np.arange(reps, dtype=np.int32)
            out["cells"] = list(acc)
            yield pd.DataFrame(out)

    part = rows.repartition(*keys, "block").mapInPandas(multiply, f"{fields}, rep int, cells array<double>")
    names = [f"{a}_{i}" for a in arms for i in range(k * k)]
    sums = part.groupBy(*by, "rep", "seed", "cond").agg(
        *[F.sum(F.col("cells")[i]).alias(n) for i, n in enumerate(names)]
    )
    return _over_seeds(sums, groups, arms, k, by, reps)


def observed(packed: DataFrame, arms: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """The same score without resampling."""
    keys = [*by, "seed", "cond"]
    sums = packed.groupBy(*keys).agg(*[c for a in arms for c in cell_sums(a, k)])
    per = _per_seed(sums, keys, arms, k)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), *[F.avg(f"s_{a}").alias(f"s_{a}") for a in arms])


def _engine(method: str) -> Callable:
    engines = {"rows": replicates, "blocks": block_replicates}
    if method not in engines:
        raise ValueError(f"method must be one of {sorted(engines)}, got {method!r}")
    return engines[method]


def _attach(obs: DataFrame, stat: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return obs.join(stat, list(by))
    key = F.lit(0).alias("_k")
    return obs.select("*", key).join(stat.select("*", key), "_k").drop("_k")


def cluster_bootstrap(
    packed: DataFrame, arm: str, k: int, by: Sequence[str] = (), reps: int = 2000, alpha: float = 0.05, method: str = "rows"
) -> DataFrame:
    """Mean macro-F1 with a percentile interval, resampling seeds and then groups."""
    packed = materialise(packed, "packed")
    r = _engine(method)(packed, [arm], k, by, reps)
    stat = r.groupBy(*by).agg(
        F.percentile(f"s_{arm}", alpha / 2).alias("lo"), F.percentile(f"s_{arm}", 1 - alpha / 2).alias("hi")
    )
    obs = observed(packed, [arm], k, by).withColumnRenamed(f"s_{arm}", "mean")
    return _attach(obs, stat, by).select(*by, "n_seeds", "mean", "lo", "hi")


def both_arms(packed: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Only the seeds in which both arms have predictions."""
    some = lambda arm: F.max(F.exists(arm, lambda x: x > 0).cast("int")) == 1
    one_sided = packed.groupBy(*by, "seed").agg((some(a) & some(b)).alias("_ok")).where("NOT _ok").drop("_ok")
    if one_sided.isEmpty():
        return packed
    return packed.join(one_sided, [*by, "seed"], "left_anti")


def paired_bootstrap(
    packed: DataFrame, a: str, b: str, k: int, by: Sequence[str] = (), reps: int = 2000, alpha: float = 0.05,
    method: str = "rows",
) -> DataFrame:
    """Mean paired difference a - b, its interval, and a two-sided p floored at 1/reps."""
    packed = both_arms(materialise(packed, "packed"), a, b, by)
    r = _engine(method)(packed, [a, b], k, by, reps).withColumn("d", F.col(f"s_{a}") - F.col(f"s_{b}"))
    tail = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    stat = r.groupBy(*by).agg(
        F.percentile("d", alpha / 2).alias("lo"), F.percentile("d", 1 - alpha / 2).alias("hi"), tail.alias("tail"),
        F.count(F.lit(1)).alias("n_boot"),
    )
    obs = observed(packed, [a, b], k, by).withColumn("diff", F.col(f"s_{a}") - F.col(f"s_{b}"))
    p = F.greatest(2.0 * F.col("tail"), F.lit(1.0 / reps))
    return _attach(obs, stat, by).select(
        *by, "n_seeds", "diff", "lo", "hi", p.alias("p"), (F.col("tail") == 0).alias("p_at_floor"), "n_boot"
    )


def family_bounds(packed: DataFrame, a: str, b: str, k: int, by: Sequence[str], m: int, reps: int = 2000) -> DataFrame:
    """One-sided Bonferroni upper bounds over ``m`` contrasts; the limiting one is flagged."""
    from pyspark.sql import Window as W

    out = paired_bootstrap(packed, a, b, k, by, reps, alpha=2 * 0.05 / m)
    top = F.max("hi").over(W.partitionBy())
    return out.select(*by, "diff", F.col("hi").alias("upper_bound"), (F.col("hi") == top).alias("limiting"))


def per_class_bootstrap(
    packed: DataFrame, arm: str, classes: Sequence[str], reps: int = 2000, alpha: float = 0.05, salt: str = "class"
) -> DataFrame:
    """Per-class precision, recall and F1 with intervals on counts pooled over seeds.

    Counts add up over the drawn seeds before scoring, and a seed drawn twice gets two
    independent group draws, so draws are keyed by position.
    """
    k = len(classes)
    packed = materialise(packed, "packed")
    groups = materialise(index_groups(packed), "groups")
    # reps x seeds rows by construction: both are parameters, not data.
    slots = F.broadcast(seed_draws(groups, reps).select("rep", "pos", "seed"))
    each = spread(groups).join(slots, "seed")
    h = draw_hash(salt, F.col("rep"), F.col("pos"), F.col("idx"))
    draws = each.select("rep", "seed", draw_index(h, F.col("group_n")).alias("idx"))
    sums = draws.join(_indexed_cells(packed, groups, ()), ["seed", "idx"]).groupBy("rep").agg(*cell_sums(arm, k))

    def long(df: DataFrame) -> DataFrame:
        rows = []
        for i, name in enumerate(classes):
            _, sup, pre = _margins(arm, k, i)
            p, r, f = class_scores(arm, k, i)
            rows.append(F.struct(
                F.lit(name).alias("class"), sup.alias("support"), pre.alias("predicted"),
                p.alias("precision"), r.alias("recall"), f.alias("f1"),
            ))
        return df.select(F.explode(F.array(*rows)).alias("c")).select("c.*")

    a, b = alpha / 2, 1 - alpha / 2
    iv = long(sums).groupBy("class").agg(
        *[F.percentile(c, q).alias(f"{c}_{t}") for c in ("precision", "recall", "f1") for t, q in (("lo", a), ("hi", b))]
    )
    obs = long(packed.agg(*cell_sums(arm, k)))
    return obs.join(iv, "class")


# ---- item bootstrap --------------------------------------------------------
def item_bootstrap(df: DataFrame, classes: Sequence[str], by: Sequence[str], item: str, reps: int, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of macro-F1 over items, drawn item by item.

    A drawn index only matters through the confusion cell it falls into, so items are
    drawn against the cumulative cell counts: no self join on the item index.
    """
    by = list(by)
    names = [f"{t}\x1f{p}" for t in classes for p in classes]
    packed = df.groupBy(*by).agg(
        F.array(*[F.count_if((F.col("y_true") == n.split("\x1f")[0]) & (F.col("y_pred") == n.split("\x1f")[1])) for n in names]).alias("cells")
    )
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, x: acc + x)
    upper = F.aggregate(
        "cells", F.array().cast("array<bigint>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)),
    )
    bounds = packed.select(*by, total.alias("n_items"), upper.alias("upper"))
    slots = spread(df.select(*by, F.col(item).alias("_slot"))).join(small_side(bounds), by)
    # Draws are made inside the exploded array, so each is hashed once and not once per bound.
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(reps - 1)),
        lambda r: F.struct(r.alias("rep"), draw_index(draw_hash("item", r, F.col("_slot")), F.col("n_items")).alias("idx")),
    )
    each = slots.select(*by, "upper", F.explode(draws).alias("_d"))
    cell = F.size(F.filter("upper", lambda u: u <= F.col("_d.idx")))
    drawn = each.select(*by, F.col("_d.rep").alias("rep"), cell.alias("cell"))
    k = len(classes)
    counts = drawn.groupBy(*by, "rep").agg(*[F.count_if(F.col("cell") == i).alias(f"c_{i}") for i in range(k * k)])
    score = _zero_macro("c", k)
    a = (1.0 - level) / 2.0
    r = counts.select(*by, score.alias("s"))
    iv = r.groupBy(*by).agg(F.percentile("s", a).alias("lo"), F.percentile("s", 1 - a).alias("hi"))
    flat = packed.select(*by, *[F.col("cells")[i].alias(f"c_{i}") for i in range(k * k)])
    return flat.select(*by, score.alias("point")).join(iv, by)


def _zero_macro(arm: str, k: int) -> Column:
    f1 = [F.coalesce(class_scores(arm, k, i)[2], F.lit(0.0)) for i in range(k)]
    return sum(f1[1:], f1[0]) / k


def metric_bootstrap(
    df: DataFrame, classes: Sequence[str], by: Sequence[str], metric: Callable[[np.ndarray], float],
    reps: int = 2000, level: float = 0.95, seed: int = 0, shards: int = 16,
) -> DataFrame:
    """Item bootstrap of any user metric of a K x K confusion matrix.

    Resampling n items and counting them is one multinomial over the observed cells, so
    the cost does not depend on the number of items. Replicates are spread over shards.
    """
    by = list(by)
    k = len(classes)
    packed = confusion_counts(df, by).groupBy(*by).agg(
        F.array(*[
            F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0))
            for t in classes for p in classes
        ]).alias("cells")
    )
    per = -(-reps // shards)
    work = packed.withColumn("shard", F.explode(F.sequence(F.lit(-1), F.lit(shards - 1)))).repartition(*by, "shard")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*by).schema)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = np.asarray(row["cells"], dtype=np.int64)
                total, s = int(n.sum()), int(row["shard"])
                # Shard -1 carries the observed value.
                m = 1 if s < 0 else max(0, min(reps, (s + 1) * per) - s * per)
                if m == 0 or total == 0:
                    continue
                if s < 0:
                    draws = n[None, :]
                else:
                    draws = np.random.default_rng([seed, s]).multinomial(total, n / total, size=m)
                out = {c: [row[c]] * m for c in by}
                out["is_point"] = [s < 0] * m
                out["score"] = [float(metric(d.reshape(k, k))) for d in draws]
                yield pd.DataFrame(out)

    prefix = f"{fields}, " if fields else ""
    r = work.mapInPandas(run, f"{prefix}is_point boolean, score double")
    a = (1.0 - level) / 2.0
    draw = F.when(~F.col("is_point"), F.col("score"))
    return r.groupBy(*by).agg(
        F.max(F.when(F.col("is_point"), F.col("score"))).alias("point"), F.count(draw).alias("n_resamples"),
        F.percentile(draw, a).alias("lo"), F.percentile(draw, 1 - a).alias("hi"),
    )


# ---- signed ranks ----------------------------------------------------------
def wilcoxon_statistic(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Signed-rank sums with average ranks; zero differences are dropped from the ranking."""
    by = list(by)
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("d")).withColumn("m", F.abs("d"))
    nonzero = d.where("d <> 0")
    ranks = value_ranks(nonzero, by, "m").withColumn("r", F.col("before") + (F.col("n") + 1) / 2.0)
    plus = nonzero.groupBy(*by, "m").agg(F.count_if(F.col("d") > 0).alias("pos"))
    n = F.col("n").cast("double")
    sums = ranks.join(plus, [*by, "m"]).groupBy(*by).agg(
        F.sum(F.col("r") * F.col("pos")).alias("w_plus"),
        F.sum(F.col("r") * (F.col("n") - F.col("pos"))).alias("w_minus"),
        F.sum("n").alias("n_nonzero"), F.sum(n * n * n - n).alias("tie_term"),
    )
    mid = exact_quantiles(d, by, "d", {"median_difference": 0.5}).withColumnRenamed("n", "n_pairs")
    out = mid.join(sums, by, "left").fillna(0, ["w_plus", "w_minus", "n_nonzero", "tie_term"])
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def _signed_rank_p(statistic: float, n: int, ties: float) -> float:
    """Two-sided p: exact for n <= 50 without ties, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2.0 * ways[: int(statistic) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    z = (statistic - mean) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2.0))


def wilcoxon(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """:func:`wilcoxon_statistic` with its p value, one row per family."""

    @F.pandas_udf("double")
    def p_value(s: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([_signed_rank_p(x, int(m), u) for x, m, u in zip(s, n, t)])

    stat = wilcoxon_statistic(pairs, by, a, b)
    return stat.withColumn("p_value", p_value("statistic", "n_nonzero", "tie_term"))


# ---- equality of two routes ------------------------------------------------
def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) on one side only; empty means the two frames are equal.

    Signed counts of one union: cheaper than two bag differences.
    """
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_s").alias("excess")).where("excess <> 0")
