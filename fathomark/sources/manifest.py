"""The item manifest: CSV with an exact header, and its portable form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The manifest's column contract.
COLUMNS = (
    "corpus", "file_path", "utterance_id", "speaker_id", "session_id", "subset",
    "original_label", "label_six", "label_four", "duration_s", "sample_rate", "sha256",
)
PORTABLE = tuple("relative_path" if c == "file_path" else c for c in COLUMNS)
_TYPES = {"duration_s": "double", "sample_rate": "int"}


class ManifestError(ValueError):
    """A manifest does not have the declared columns, or a path lies outside its root."""


def schema(columns: Sequence[str] = COLUMNS) -> str:
    return ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in columns)


def _texts(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in _TYPES]


def write_manifest(df: DataFrame, path: str, columns: Sequence[str] = COLUMNS, mode: str = "errorifexists") -> None:
    """CSV in a fixed column and row order; null becomes the empty string."""
    key = "relative_path" if "relative_path" in columns else "utterance_id"
    out = df.select(*columns).na.fill("", _texts(columns))
    out.orderBy("corpus", key).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Manifest rows with empty text as null. The header must match exactly."""
    head = spark.read.option("header", "true").option("inferSchema", "false").csv(path).columns
    if list(head) != list(columns):
        raise ManifestError(f"header {head} is not {list(columns)}")
    df = spark.read.option("header", "true").option("enforceSchema", "false").schema(schema(columns)).csv(path)
    return df.select(*[
        F.when(F.col(c) != "", F.col(c)).alias(c) if c in _texts(columns) else F.col(c) for c in columns
    ])


def relative_to(path: Column, root: Column) -> Column:
    """Part of ``path`` below ``root``; null when it lies outside."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    base = F.concat(r, F.lit("/"))
    inside = F.startswith(p, base) & ~F.contains(p, F.lit("/../"))
    return F.when(inside, F.substr(p, F.length(base) + 1))


def to_portable(df: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths relative to their corpus root, in a deterministic order of rows.

    ``roots`` has corpus and root. Rows outside their root keep a null path; see
    :func:`outside_root`.
    """
    j = df.join(roots, "corpus")
    return j.withColumn("relative_path", relative_to(F.col(path), F.col("root"))).drop("root", path)


def outside_root(portable: DataFrame) -> DataFrame:
    return portable.where("relative_path IS NULL")


def resolve_path(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Absolute paths again, on this machine's roots."""
    return df.join(roots, "corpus").withColumn("file_path", F.concat_ws("/", F.rtrim("root", F.lit("/")), "relative_path")).drop(
        "root", "relative_path"
    )


def load_items(spark: SparkSession, portable: str, local: str, roots: DataFrame) -> DataFrame:
    """The portable manifest when it exists, else the local one; same columns either way."""
    try:
        return resolve_path(read_manifest(spark, portable, PORTABLE), roots).select(*COLUMNS)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    return read_manifest(spark, local)
