"""Confusion counts and every score derived from them.

Predictions are reduced once to (keys, y_true, y_pred, n); nothing after that
looks at an item again. The reduction combines map side, so its shuffle carries
at most K*K rows per key and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed (true, predicted) counts; additive over any grouping."""
    return df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_by_group(df: DataFrame, by: Sequence[str], grp: str) -> DataFrame:
    """Counts kept apart per group: the sufficient statistic of the cluster bootstrap."""
    return confusion_counts(df, [*by, grp])


def confusion(df: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Full K x K frame per key, zeros included. The counts carry their own frame, so the input is read once."""
    k = len(classes)
    names = F.array(*[F.lit(c) for c in classes])
    packed = pack_confusion(confusion_counts(df, by), classes, by)
    return packed.select(*by, F.posexplode("cells").alias("pos", "n")).select(
        *by, F.get(names, F.floor(F.col("pos") / k).cast("int")).alias("y_true"),
        F.get(names, F.col("pos") % k).alias("y_pred"), "n",
    )


def conf_rate(conf: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion normalised by true class; a class without truth has no rate."""
    total = F.sum("n").over(W.partitionBy(*by, "y_true"))
    return conf.withColumn("rate", F.try_divide(F.col("n").cast("double"), total.cast("double")))


def class_margins(counts: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """tp, support and predicted per class from one pass over confusion counts.

    Each count row feeds its true class and its predicted class, which replaces
    two separate aggregations and the join between them.
    """
    n = F.col("n")
    zero = F.lit(0).cast("long")
    hit = F.col("y_true") == F.col("y_pred")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("class"), F.when(hit, n).otherwise(zero).alias("tp"),
            n.alias("support"), zero.alias("predicted"),
        ),
        F.struct(
            F.col("y_pred").alias("class"), zero.alias("tp"),
            zero.alias("support"), n.alias("predicted"),
        ),
    )
    blank = F.transform(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.struct(c.alias("class"), zero.alias("tp"), zero.alias("support"), zero.alias("predicted")),
    )
    # Every count row also carries zero rows for all classes: absent classes survive
    # without a second read of the input to find the keys.
    return (
        counts.select(*by, F.explode(F.concat(sides, blank)).alias("m"))
        .groupBy(*by, F.col("m.class").alias("class"))
        .agg(
            F.sum("m.tp").alias("tp"), F.sum("m.support").alias("support"),
            F.sum("m.predicted").alias("predicted"),
        )
        .where(F.col("class").isin(list(classes)))
    )


def f1_zero(tp: Column, support: Column, predicted: Column) -> Column:
    """F1 with an absent class scored 0."""
    return F.coalesce(f1_drop(tp, support, predicted), F.lit(0.0))


def f1_drop(tp: Column, support: Column, predicted: Column) -> Column:
    """F1 with an absent class left null, so an average skips it."""
    return F.try_divide(2.0 * tp.cast("double"), (support + predicted).cast("double"))


def score_margins(margins: DataFrame) -> DataFrame:
    tp, sup, pre = F.col("tp"), F.col("support"), F.col("predicted")
    zero = F.lit(0.0)
    return (
        margins.withColumn("precision", F.coalesce(F.try_divide(tp.cast("double"), pre.cast("double")), zero))
        .withColumn("recall", F.coalesce(F.try_divide(tp.cast("double"), sup.cast("double")), zero))
        .withColumn("f1", f1_zero(tp, sup, pre))
        .withColumn("f1_or_null", f1_drop(tp, sup, pre))
    )


def per_class(counts: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    return score_margins(class_margins(counts, classes, by))


def macro_f1(counts: DataFrame, classes: Sequence[str], by: Sequence[str], absent: str = "zero") -> DataFrame:
    """``absent='zero'`` averages over all classes, ``'drop'`` over classes seen on either side."""
    if absent not in ("zero", "drop"):
        raise ValueError(f"absent must be 'zero' or 'drop', got {absent!r}")
    col = "f1" if absent == "zero" else "f1_or_null"
    return per_class(counts, classes, by).groupBy(*by).agg(F.avg(col).alias("macro_f1"))


def all_metrics(counts: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Both macro-F1 variants, accuracy, UAR and collapsed classes from one margin table."""
    scored = per_class(counts, classes, by)
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.avg("f1").alias("macro_f1"),
        F.avg("f1_or_null").alias("macro_f1_present"),
        F.coalesce(
            F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")), F.lit(0.0)
        ).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("uar"),
        F.count_if(F.col("predicted") == 0).alias("n_collapsed"),
    )


def collapsed(counts: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The classes that are never predicted."""
    return class_margins(counts, classes, by).where("predicted = 0").select(*by, "class", "support")


def pack_confusion(counts: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key with the K*K counts as an array in row-major order."""
    cells = []
    for t in classes:
        for p in classes:
            hit = (F.col("y_true") == t) & (F.col("y_pred") == p)
            cells.append(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long"))
    return counts.groupBy(*by).agg(F.array(*cells).alias("cells"))


def unpack_confusion(packed: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Back to long rows; cells without a count are dropped."""
    k = len(classes)
    names = F.array(*[F.lit(c) for c in classes])
    return (
        packed.select(*by, F.posexplode("cells").alias("pos", "n"))
        .where("n <> 0")
        .select(
            *by,
            F.get(names, F.floor(F.col("pos") / k).cast("int")).alias("y_true"),
            F.get(names, F.col("pos") % k).alias("y_pred"),
            "n",
        )
    )
