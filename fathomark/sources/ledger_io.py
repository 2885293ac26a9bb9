"""Ledger, prediction, confusion and vector storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest_rows
from ..operators.ledger import ledger_rules, ledger_schema, schema_problems, violations


class LedgerError(ValueError):
    """Rows that may not enter or leave the ledger."""


def _missing(exc: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(exc)


def read_ledger(spark: SparkSession, path, schema=None) -> DataFrame:
    """JSON lines under the fixed schema, with ``source_file``; a missing path is an empty ledger.

    Unparsable lines stay visible in ``_corrupt_record``; see :func:`bad_lines`.
    """
    schema = schema or ledger_schema()
    full = type(schema)(list(schema.fields)).add("_corrupt_record", "string")
    try:
        df = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
        return df.select("*", F.col("_metadata.file_path").alias("source_file"))
    except AnalysisException as exc:
        if not _missing(exc):
            raise
        return spark.createDataFrame([], full.add("source_file", "string"))


def bad_lines(ledger: DataFrame) -> DataFrame:
    """File, readable run id and text of every line that is not a ledger row."""
    # Spark refuses a scan of the corrupt column alone, so a data column is selected too.
    return ledger.where(F.col("_corrupt_record").isNotNull()).select("source_file", "run_id", "_corrupt_record")


# JSON lines repeat the names of all columns; gzip takes them out. A gzip file is read by one task, so its rows are bounded.
JSON_FILE_ROWS = 500_000


def append_ledger(df: DataFrame, path: str, validate: bool = True, fmt: str = "json", file_rows: int = JSON_FILE_ROWS) -> None:
    """Append rows that pass the schema and every row rule; nothing is written otherwise.

    JSON lines are gzipped, at most ``file_rows`` rows a file; readers take them beside plain files.
    """
    if validate:
        problems = schema_problems(df)
        if problems:
            raise LedgerError("; ".join(problems))
        bad = violations(df, ledger_rules(), ["run_id"]).limit(5).collect()
        if bad:
            raise LedgerError("; ".join(f"{r.run_id}: {r.rule}" for r in bad))
    out = df.write.mode("append").option("ignoreNullFields", "false").option("maxRecordsPerFile", file_rows)
    if fmt == "json":
        out = out.option("compression", "gzip")
    out.format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, chunk: int = 100_000) -> None:
    """Gzipped JSON of parallel id and label arrays per run, at most ``chunk`` items per record.

    Long runs become several records, so no record has to hold a whole run.
    """
    part = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30))
    sized = df.join(df.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_k")), "run_id")
    packed = sized.groupBy("run_id", F.pmod(part, F.col("_k")).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("item_id", "y_pred"))).alias("r")
    )
    out = packed.select(
        "run_id", F.transform("r", lambda x: x["item_id"]).alias("utterance_ids"), F.transform("r", lambda x: x["y_pred"]).alias("predicted")
    )
    out.write.option("compression", "gzip").json(path)


PREDICTION_SCHEMA = "run_id string, utterance_ids array<string>, predicted array<string>"


def read_predictions(spark: SparkSession, paths) -> DataFrame:
    """(run_id, item_id, y_pred). Stored paths may use either separator."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(PREDICTION_SCHEMA).json([p.replace("\\", "/") for p in paths])
    z = F.explode(F.arrays_zip("utterance_ids", "predicted")).alias("z")
    return df.select("run_id", z).select("run_id", F.col("z.utterance_ids").alias("item_id"), F.col("z.predicted").alias("y_pred"))


def ragged_predictions(spark: SparkSession, paths) -> DataFrame:
    """Records whose two arrays differ in length."""
    return spark.read.schema(PREDICTION_SCHEMA).json(paths).where(F.size("utterance_ids") != F.size("predicted")).select("run_id")


def write_conf(packed: DataFrame, path: str, classes: Sequence[str]) -> None:
    """Packed confusions: integral, non-negative, K*K cells, in a fixed row order."""
    k2 = len(classes) ** 2
    kind = packed.schema["cells"].dataType.simpleString()
    if kind != "array<bigint>":
        raise LedgerError(f"cells must be array<bigint>, got {kind}")
    bad = packed.where((F.size("cells") != k2) | F.exists("cells", lambda x: x < 0)).limit(1)
    if not bad.isEmpty():
        raise LedgerError(f"cells must hold {k2} non-negative counts")
    out = packed.withColumn("class_names", F.array(*[F.lit(c) for c in classes]))
    keys = [c for c in packed.columns if c != "cells"]
    out.sortWithinPartitions(*keys).write.parquet(path)


def read_conf(spark: SparkSession, path: str, classes: Sequence[str]) -> DataFrame:
    df = spark.read.parquet(path)
    names = [r[0] for r in df.select("class_names").distinct().limit(2).collect()]
    if names != [list(classes)]:
        raise LedgerError(f"stored classes {names} are not {list(classes)}")
    return df.drop("class_names")


def vectors_key(items: DataFrame, extra: Sequence[str] = ()) -> str:
    """Content key of an item list: ids, digests and any setting columns."""
    entry = F.concat_ws("|", *[F.col(c).cast("string") for c in ("item_id", "sha256", *extra)])
    return digest_rows(items, [], entry).collect()[0]["digest"][:16]


def write_vectors(df: DataFrame, path: str, key: str) -> None:
    """Vectors under their content key. An existing key is never overwritten."""
    df.write.mode("errorifexists").partitionBy(*[c for c in ("corpus", "backbone", "layer") if c in df.columns]).parquet(f"{path}/key={key}")


def read_vectors(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{path}/key={key}").withColumn("v", F.col("v").cast("array<double>"))


def has_vectors(spark: SparkSession, path: str, key: str) -> bool:
    """Whether a key is complete: the success marker is written by the commit only."""
    try:
        return not spark.read.parquet(f"{path}/key={key}").limit(1).isEmpty()
    except AnalysisException as exc:
        if _missing(exc):
            return False
        raise


def read_union(spark: SparkSession, primary: str, shards: Sequence[str], schema=None) -> DataFrame:
    """The canonical artifact when it exists, else its shards; ``origin`` says which."""
    schema = schema or ledger_schema()
    for origin, paths in (("canonical", [primary]), ("shards", list(shards))):
        try:
            df = spark.read.schema(schema).json(paths)
            return df.select("*", F.lit(origin).alias("origin"), F.col("_metadata.file_path").alias("source_file"))
        except AnalysisException as exc:
            if not _missing(exc):
                raise
    raise LedgerError(f"neither {primary} nor {list(shards)} exists")


def write_stats(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Long statistics table as CSV with a header, in a fixed order."""
    df.orderBy(*order).write.option("header", "true").csv(path)
