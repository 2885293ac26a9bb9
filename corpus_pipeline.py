"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame with the columns of
``documents``; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256. Empty texts, null texts and rows with
null ids go through every stage (no operator can judge them), repeated rows as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm import bpe, decontaminate, near_dup, substrings, toxicity
from fathomark.llm.queries import vocabulary_path
from fathomark.plans.registry import table
from fathomark.sources.scratch import materialise

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the operator's threshold go; the model learns from ``docs`` and the labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component stays."""
    return near_dup.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that an earlier document has go; ``n_chars`` follows the text."""
    cut = substrings.cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lie in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    out = bpe.encode(docs, vocabulary_path(), decoded=True, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
