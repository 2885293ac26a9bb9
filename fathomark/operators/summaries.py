"""Grouped summaries over items and ledger rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import best_by, exact_quantiles

# Two-sided 95 % t quantiles for n = 2..5; 1.96 beyond.
T_TABLE = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776}


def _n() -> Column:
    return F.count(F.lit(1))


def rate_of(flag: Column) -> Column:
    """Share of rows where ``flag`` is true; null or false rows count against it."""
    return F.count_if(flag).cast("double") / _n()


def corpus_stats(items: DataFrame) -> DataFrame:
    """Groups, items, hours, mean duration, kept and excluded items per corpus.

    Items fold into (corpus, group) first: the distinct count then is a row count,
    and one huge corpus is spread over its groups.
    """
    per = items.groupBy("corpus", "grp").agg(
        _n().alias("n"), F.sum("duration_s").alias("s"), F.count("label").alias("kept")
    )
    return per.groupBy("corpus").agg(
        _n().alias("n_groups"), F.sum("n").alias("n_items"),
        (F.sum("s") / 3600.0).alias("hours"), (F.sum("s") / F.sum("n")).alias("mean_duration"),
        F.sum("kept").alias("n_kept"), (F.sum("n") - F.sum("kept")).alias("n_excluded"),
    )


def check_counts(stats: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Published sizes against observed: items within a share, groups exact."""
    j = expected.join(stats, "corpus", "left")
    items_ok = F.abs(F.col("n_items") - F.col("expected_items")) <= F.lit(tolerance) * F.col("expected_items")
    groups_ok = F.col("n_groups") == F.col("expected_groups")
    return j.select(
        "corpus", "n_items", "expected_items", "n_groups", "expected_groups",
        F.coalesce(items_ok, F.lit(False)).alias("items_ok"), F.coalesce(groups_ok, F.lit(False)).alias("groups_ok"),
    )


def seed_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean with a t interval; null and non-finite values dropped, no interval from one value."""
    v = F.col(value)
    good = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    g = good.groupBy(*by).agg(_n().alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"))
    table = F.create_map(*[F.lit(x) for kv in T_TABLE.items() for x in kv])
    crit = F.coalesce(F.try_element_at(table, F.col("n").cast("int")), F.lit(1.96))
    half = F.when(F.col("n") > 1, crit * F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def per_seed(df: DataFrame, by: Sequence[str], value: str, seed: str = "seed") -> DataFrame:
    """Average inside each seed first, then the interval across seeds."""
    inner = df.groupBy(*by, seed).agg(F.avg(value).alias("_v"))
    return seed_interval(inner, by, "_v")


def axis_summary(df: DataFrame, axis: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(axis).agg(
        _n().alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def solver_summary(df: DataFrame, by: str, cap: int) -> DataFrame:
    """Iteration counts: min, exact median, max, runs at the cap, failed trials."""
    seen = df.where("solver_n_iter IS NOT NULL")
    med = exact_quantiles(seen, [by], "solver_n_iter", {"median": 0.5}).select(by, "median")
    g = seen.groupBy(by).agg(
        _n().alias("n"), F.min("solver_n_iter").alias("min"), F.max("solver_n_iter").alias("max"),
        F.count_if(F.col("solver_n_iter") >= cap).alias("n_at_cap"),
        F.sum(F.coalesce(F.get_json_object("hyperparams_json", "$.n_failed").cast("long"), F.lit(0))).alias("n_failed"),
    )
    return g.join(med, by)


def rate(df: DataFrame, flag: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        _n().alias("n"), F.count_if(F.col(flag)).alias("n_true"), rate_of(F.col(flag)).alias("rate")
    )


def cost_shares(df: DataFrame, by: str, seconds: str = "wall_seconds") -> DataFrame:
    g = df.groupBy(by).agg(_n().alias("n"), (F.sum(seconds) / 3600.0).alias("hours"))
    return g.withColumn("share", F.col("hours") / F.sum("hours").over(W.partitionBy()))


def project_cost(
    plan: DataFrame, history: DataFrame, ratios: DataFrame, key: Sequence[str], fallback: Sequence[str],
    seconds: str = "wall_seconds",
) -> DataFrame:
    """Planned runs x median historic cost x measured ratio; keys without history use ``fallback``.

    The plan is counted per key first, so the joins meet aggregates on both sides.
    """
    fine = exact_quantiles(history, key, seconds, {"fine": 0.5}).select(*key, "fine")
    coarse = exact_quantiles(history, fallback, seconds, {"coarse": 0.5}).select(*fallback, "coarse")
    runs = plan.groupBy(*key).agg(_n().alias("runs"))
    j = runs.join(fine, list(key), "left").join(coarse, list(fallback), "left").join(ratios, list(fallback), "left")
    each = F.coalesce("fine", "coarse") * F.coalesce("ratio", F.lit(1.0))
    return j.select(
        *key, "runs", F.coalesce("fine", "coarse").alias("median_seconds"), F.col("fine").isNull().alias("used_fallback"),
        (F.col("runs") * each / 3600.0).alias("hours"),
    )


def integrity(df: DataFrame) -> DataFrame:
    """Row, id and status counts in one row. Ids fold first, so the distinct count scales out."""
    per_id = df.groupBy("run_id").agg(
        _n().alias("n"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.collect_set("schema_version").alias("v"),
    )
    return per_id.agg(
        F.sum("n").alias("n_rows"), _n().alias("n_ids"), F.sum("ok").alias("n_ok"),
        (F.sum("n") - F.sum("ok")).alias("n_failed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).cast("array<string>"), ",").alias("versions"),
    )


def complete_groups(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Groups with their cell count and whether they have all ``n`` cells."""
    return df.groupBy(*by).agg(_n().alias("cells")).withColumn("included", F.col("cells") >= n)


def subset_counts(df: DataFrame, subset: str, label: str, session: str) -> DataFrame:
    return df.groupBy(subset, label, session).agg(_n().alias("n"))


def subset_decision(
    counts: DataFrame, preferred: str, fallback: str, classes: Sequence[str], sessions: Sequence[str],
    min_class: int, min_sessions: int, min_cell: int,
) -> DataFrame:
    """Whether the preferred subset is adequate, each failed check, and the choice.

    ``counts`` holds one row per (subset, label, session); absent cells count as zero.
    """
    per_session = [
        F.coalesce(F.sum(F.when(F.col("session") == s, F.col("n"))), F.lit(0)).alias(f"s{i}")
        for i, s in enumerate(sessions)
    ]
    pick = counts.where(F.col("subset") == preferred)
    frame = counts.groupBy().agg(F.lit(1).alias("_one")).select(
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("label")
    )
    g = frame.join(pick.groupBy("label").agg(*per_session), "label", "left").fillna(0)
    cells = F.array(*[F.col(f"s{i}") for i in range(len(sessions))])
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    present = F.size(F.filter(cells, lambda x: x > 0))
    thin = F.size(F.filter(cells, lambda x: x < min_cell))
    reasons = F.array_compact(F.array(
        F.when(total < min_class, F.concat("label", F.format_string(f": %d items < {min_class}", total))),
        F.when(present < min_sessions, F.concat("label", F.format_string(f": in %d sessions < {min_sessions}", present))),
        F.when(thin > 0, F.concat("label", F.format_string(f": below {min_cell} in %d sessions", thin))),
    ))
    failed = g.agg(F.array_sort(F.flatten(F.collect_list(reasons))).alias("failed_checks"))
    return failed.select(
        F.when(F.size("failed_checks") == 0, preferred).otherwise(fallback).alias("chosen"), "failed_checks"
    )


def with_total(df: DataFrame, by: str, aggs: Sequence[Column]) -> DataFrame:
    """Grouped rows plus one pooled row (null key, ``is_total`` true)."""
    return df.rollup(by).agg(*aggs, (F.grouping(by) == 1).alias("is_total"))


def reduction_ratio(df: DataFrame, by: Sequence[str], rung: str, base: str, num: str, den: str) -> DataFrame:
    """Conditional over marginal discrepancy per rung, and relative to the unaligned rung."""
    per = df.groupBy(*by, rung, "seed").agg(F.avg(num).alias("a"), F.avg(den).alias("b"))
    m = per.groupBy(*by, rung).agg(F.avg("a").alias("num"), F.avg("b").alias("den"))
    m = m.withColumn("ratio", F.try_divide("num", "den"))
    ref = F.max(F.when(F.col(rung) == base, F.col("ratio"))).over(W.partitionBy(*by))
    return m.withColumn("relative", F.try_divide(F.col("ratio"), ref))


def validated_oracle(ledger: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per seed: the score of the run best on validation, the best score there is, and the gap."""
    scored = ledger.where("val IS NOT NULL AND test IS NOT NULL")
    g = scored.groupBy(*by, "seed").agg(
        F.min_by("test", F.struct(-F.col("val"), *order)).alias("validated"), F.max("test").alias("oracle")
    )
    return g.withColumn("gap", F.col("oracle") - F.col("validated"))


def intervals(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """:func:`seed_interval` of several columns in long form."""
    long = df.select(
        *by, F.explode(F.array(*[F.struct(F.lit(v).alias("quantity"), F.col(v).alias("v")) for v in values])).alias("q")
    ).select(*by, "q.*")
    return seed_interval(long, [*by, "quantity"], "v")


def depth_gap(ledger: DataFrame, by: Sequence[str], axis: str, min_cells: int = 3) -> DataFrame:
    """Axis value best on validation against best on target, and what the difference costs.

    Runs are first averaged per axis cell; first axis value wins a tie.
    """
    cells = ledger.where("val IS NOT NULL AND test IS NOT NULL").groupBy(*by, axis).agg(
        F.avg("val").alias("val"), F.avg("test").alias("test")
    )
    pick = lambda col, score: F.min_by(col, F.struct(-F.col(score), axis))
    g = cells.groupBy(*by).agg(
        _n().alias("n_cells"), pick(axis, "val").alias("at_val"), pick(axis, "test").alias("at_test"),
        F.max("test").alias("_best"), pick("test", "val").alias("_picked"), F.avg("test").alias("_mean"),
    ).where(F.col("n_cells") >= min_cells)
    cost, rnd = F.col("_best") - F.col("_picked"), F.col("_best") - F.col("_mean")
    return g.select(
        *by, "n_cells", "at_val", "at_test", (F.col("at_test") - F.col("at_val")).alias("gap"),
        cost.alias("cost"), rnd.alias("random_cost"), (cost - rnd).alias("paired_difference"),
    )


def sign_disagree(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both intervals exclude zero and lie on opposite sides."""
    x = a.select(*by, F.col("mean").alias("a_mean"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    y = b.select(*by, F.col("mean").alias("b_mean"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    clear = (F.col("a_lo") * F.col("a_hi") > 0) & (F.col("b_lo") * F.col("b_hi") > 0)
    opposite = F.col("a_mean") * F.col("b_mean") < 0
    return x.join(y, list(by)).select(
        *by, "a_mean", "b_mean", F.coalesce(clear & opposite, F.lit(False)).alias("disagree")
    )


def axis_argmax(df: DataFrame, by: Sequence[str], axis: str, value: str) -> DataFrame:
    """Best value of a numeric axis, whether it sits on the grid edge, and the spread."""
    m = df.where(F.col(axis).isNotNull() & F.col(value).isNotNull()).groupBy(*by, axis).agg(F.avg(value).alias("m"))
    return m.groupBy(*by).agg(
        F.min_by(axis, F.struct(-F.col("m"), axis)).alias("best"), F.min(axis).alias("lowest"),
        F.max(axis).alias("highest"), (F.max("m") - F.min("m")).alias("spread"),
    ).withColumn("at_edge", (F.col("best") == F.col("lowest")) | (F.col("best") == F.col("highest")))


def contrasts(df: DataFrame, cond: Sequence[str], axis: str, values: Sequence[str], value: str) -> DataFrame:
    """Mean paired difference b - a of every declared contrast, over conditions that have both.

    The axis values are a declared list, so each condition is pivoted to one row with
    a column per value and no two data rows are ever paired.
    """
    cells = [F.avg(F.when(F.col(axis) == v, F.col(value))).alias(f"_m{i}") for i, v in enumerate(values)]
    wide = df.where(F.col(axis).isin(list(values))).groupBy(*cond).agg(*cells)
    pairs = [
        F.struct(F.lit(values[i]).alias("a"), F.lit(values[j]).alias("b"), (F.col(f"_m{j}") - F.col(f"_m{i}")).alias("d"))
        for i in range(len(values)) for j in range(i + 1, len(values))
    ]
    long = wide.select(F.explode(F.array(*pairs)).alias("c")).select("c.*").where("d IS NOT NULL")
    return long.groupBy("a", "b").agg(_n().alias("n_conditions"), F.avg("d").alias("difference"))


def widest_contrast(contrast_rows: DataFrame, step: float) -> DataFrame:
    """Largest absolute difference of a contrast table, also as a share of a reference step."""
    first = F.min_by(F.struct("a", "b", "n_conditions", "difference"), F.struct(-F.abs("difference"), "a", "b"))
    w = contrast_rows.agg(first.alias("w")).select("w.*")
    return w.withColumn("percent_of_step", 100.0 * F.abs("difference") / F.lit(step))


def class_order(scores: DataFrame, by: Sequence[str], label: str = "class", value: str = "f1") -> DataFrame:
    """Weakest class first, and the classes below average in every direction."""
    w = W.partitionBy(*by)
    low = F.col(value) < F.avg(value).over(w)
    d = scores.withColumn("position", F.row_number().over(w.orderBy(value, label))).withColumn("below", low)
    return d.withColumn("below_in_all", F.min("below").over(W.partitionBy(label)))


def gain(df: DataFrame, by: Sequence[str], rung: str = "alignment", base: str = "none", value: str = "test") -> DataFrame:
    """Mean aligned score minus mean unaligned score."""
    un, al = F.avg(F.when(F.col(rung) == base, F.col(value))), F.avg(F.when(F.col(rung) != base, F.col(value)))
    return df.groupBy(*by).agg(un.alias("unaligned"), al.alias("aligned"), (al - un).alias("gain"))


def best_runs(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("run_id",)) -> DataFrame:
    return best_by(df, by, "val", order)


def gate(df: DataFrame, floor: str = "chance", value: str = "test") -> DataFrame:
    """Completed runs that do not beat their own floor."""
    return df.where((F.col("status") == "ok") & (F.col(value) <= F.col(floor)))
