"""Labelled rows for the two classifiers: a bounded, hash-ordered sample, never from the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _marked(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(marked_id, label) outside the fold; rows with null ids, null labels or conflicting labels do not train."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    rows = rows.filter("low = high").filter(fold(F.col("doc_id"), folds) != held_out)
    return rows.select(F.col("doc_id").cast("long").alias("marked_id"), F.col("low").cast("int").alias("label"))


def class_counts(labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[int, int]:
    """All training rows of class 0 and of class 1."""
    found = {r["label"]: r["count"] for r in _marked(labels, label, folds, held_out).groupBy("label").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: tuple[int, int], chars: int) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs of class 0 and 1, texts of up to ``chars`` characters, in a fixed order.

    Rows are taken in the order of a hash of the id, so the sample does not depend on partitions. A null text is
    an empty one. Of rows that share an id the least text trains. The bound is 2 parameters: rows and chars.
    """
    marked = _marked(labels, label, folds, held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= chars)
    # Ids are chosen before texts are read, with a margin for texts that are missing or too long.
    few = None
    for value in (0, 1):
        part = marked.filter(F.col("label") == value).orderBy(F.xxhash64("marked_id"), "marked_id").limit(2 * rows[value])
        few = part if few is None else few.union(part)
    found = texts.join(F.broadcast(few), F.col("doc_id") == F.col("marked_id")).groupBy("marked_id", "label").agg(F.min("text").alias("text"))
    # At most 2 * (rows[0] + rows[1]) texts of `chars` characters.
    order = found.withColumn("at", F.xxhash64("marked_id")).collect()
    out = []
    for value in (0, 1):
        chosen = sorted((r["at"], r["marked_id"], r["text"]) for r in order if r["label"] == value)[: rows[value]]
        out += [(text, value) for _, _, text in chosen]
    return out
