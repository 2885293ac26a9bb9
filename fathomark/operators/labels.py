"""Mapping raw labels of a corpus into a shared label space."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The label codes three public speech corpora write in file names
# and annotation files, and the raw labels each corpus can produce.
RAVDESS_CODES = {
    "01": "neutral", "02": "calm", "03": "happy", "04": "sad",
    "05": "angry", "06": "fear", "07": "disgust", "08": "surprised",
}
CREMAD_CODES = {
    "ANG": "angry", "DIS": "disgust", "FEA": "fear",
    "HAP": "happy", "NEU": "neutral", "SAD": "sad",
}
IEMOCAP_CODES = {
    "ang": "angry", "dis": "disgust", "exc": "excited", "fea": "fear",
    "fru": "frustrated", "hap": "happy", "neu": "neutral", "oth": "other",
    "sad": "sad", "sur": "surprised", "xxx": "xxx",
}
SPACES = {
    "six": ("angry", "disgust", "fear", "happy", "neutral", "sad"),
    "four": ("angry", "happy", "neutral", "sad"),
}

RULES_SCHEMA = "corpus string, raw string, space string, mapped string"


@dataclass(frozen=True)
class LabelPolicy:
    """The open labelling decisions, stated once and turned into rule rows."""

    spaces: Mapping[str, Sequence[str]] = field(default_factory=lambda: SPACES)
    excited_to_happy: bool = True
    frustrated: str = "drop"
    calm_to_neutral: bool = True

    def __post_init__(self):
        if self.frustrated not in ("drop", "merge_angry"):
            raise ValueError(f"frustrated must be 'drop' or 'merge_angry', got {self.frustrated!r}")

    def _merge(self, corpus: str, raw: str) -> str | None:
        overrides = {
            ("ravdess", "calm"): "neutral" if self.calm_to_neutral else "calm",
            ("iemocap", "excited"): "happy" if self.excited_to_happy else "excited",
            ("iemocap", "frustrated"): "angry" if self.frustrated == "merge_angry" else None,
            ("iemocap", "xxx"): None, ("iemocap", "other"): None, ("iemocap", "surprised"): None,
        }
        return overrides.get((corpus, raw), raw)

    def rules(self, spark: SparkSession) -> DataFrame:
        """One row per (corpus, raw, space); ``mapped`` null means deliberately excluded."""
        codes = {"ravdess": RAVDESS_CODES, "cremad": CREMAD_CODES, "iemocap": IEMOCAP_CODES}
        rows = []
        for corpus, table in codes.items():
            for raw in sorted(set(table.values())):
                merged = self._merge(corpus, raw)
                for space, classes in self.spaces.items():
                    rows.append((corpus, raw, space, merged if merged in classes else None))
        return spark.createDataFrame(rows, RULES_SCHEMA)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", F.lower(F.trim("corpus"))).withColumn("_r", F.lower(F.trim("raw")))


def map_labels(df: DataFrame, rules: DataFrame, space: str) -> DataFrame:
    """Adds ``label`` (null when excluded) and ``known`` (false when no rule covers the raw label).

    The rule table is a local relation, so Catalyst sees its size and broadcasts it.
    """
    r = rules.where(F.col("space") == space).select(
        F.col("corpus").alias("_c"), F.col("raw").alias("_r"),
        F.col("mapped").alias("label"), F.lit(True).alias("_hit"),
    )
    return (
        _keyed(df).join(r, ["_c", "_r"], "left")
        .withColumn("known", F.coalesce("_hit", F.lit(False)))
        .drop("_c", "_r", "_hit")
    )


def unknown_labels(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Raw labels outside the declared domain, with their counts. Must be empty before a run."""
    r = rules.select(F.col("corpus").alias("_c"), F.col("raw").alias("_r")).distinct()
    labelled = _keyed(df.where(F.col("raw").isNotNull()))
    return (
        labelled.join(r, ["_c", "_r"], "left_anti")
        .groupBy(F.col("_c").alias("corpus"), F.col("_r").alias("raw"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def remap(df: DataFrame, rules: DataFrame, space: str) -> DataFrame:
    """The same items under another policy or space."""
    return map_labels(df.drop("label", "known"), rules, space)


def verify_labels(df: DataFrame, rules: DataFrame, space: str, stored: str) -> DataFrame:
    """Items whose stored label differs from the recomputed one, nulls compared as values."""
    fresh = map_labels(df, rules, space)
    return fresh.where(~F.col(stored).eqNullSafe(F.col("label")))


def seen_only(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label occurs in ``train``; the right side is reduced to distinct labels first."""
    return df.join(train.select(label).distinct(), label, "left_semi")


def label_set_difference(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Labels present on one side only; empty means the label sets are equal."""
    left = a.select(label).distinct().withColumn("_a", F.lit(1))
    right = b.select(label).distinct().withColumn("_b", F.lit(1))
    return left.join(right, label, "full_outer").where("_a IS NULL OR _b IS NULL").select(
        label, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("only_in")
    )


def support_guard(value: Column, support: Column, min_n: int) -> list[Column]:
    """The value where support suffices, otherwise null and the reason."""
    ok = support >= min_n
    return [
        F.when(ok, value).alias("value"),
        F.when(~ok, F.format_string(f"support below {min_n} (%d)", support)).alias("undefined_reason"),
    ]
