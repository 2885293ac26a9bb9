"""Corpus folders, annotation files and names turned into item rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import CREMAD_CODES, IEMOCAP_CODES, RAVDESS_CODES

# File-name and annotation formats of three public corpora.
RAVDESS_STEM = r"^(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})$"
CREMAD_STEM = r"^(\d{4})_([A-Z]{3})_([A-Z]{3})_([A-Z]{2})$"
IEMOCAP_SUMMARY = r"^\[[\d.]+\s*-\s*[\d.]+\]\s+(Ses\d{2}[FM]_\w+)\s+([a-z]{3})\s+\[[-\d.,\s]+\]\s*$"
IEMOCAP_ID = r"^Ses(\d{2})([FM])_((impro|script)\w*?)_([FM])(\d{3})$"

ITEM_FIELDS = ("item_id", "speaker_id", "session_id", "subset", "raw")


class ScanError(ValueError):
    """A corpus folder holds something the scan cannot account for."""


def code_label(col: Column, table: Mapping[str, str]) -> Column:
    """Label of a code through a literal map; null for an unknown code."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def scan_files(spark: SparkSession, roots: Mapping[str, str], glob: str = "*.wav", content: bool = True) -> DataFrame:
    """One row per file of every corpus root. A missing root is an error from the reader.

    Without ``content`` only the file listing is read.
    """
    out = None
    for corpus, root in roots.items():
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        cols = ["path", "length"] + (["content"] if content else [])
        one = df.select(F.lit(corpus).alias("corpus"), *cols)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ScanError("no corpus roots given")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return out.withColumn("stem", stem)


def with_digest(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(content, 256))


HEADER = "struct<rate:int,frames:bigint,problem:string>"


def riff_header(content: bytes | None) -> tuple[int | None, int | None, str | None]:
    """(sample rate, frames, problem) of a RIFF/WAVE file, found by walking its chunks; a problem leaves the others null.

    Chunks may come in any order and number; each is padded to an even length. Only their headers are looked at.
    """
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None, None, "not a RIFF/WAVE file"
    at, rate, width = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt ":
            if size < 16 or body + 16 > len(content):
                return None, None, "format chunk is cut"
            rate, width = int.from_bytes(content[body + 4 : body + 8], "little"), int.from_bytes(content[body + 12 : body + 14], "little")
            if not rate or not width:
                return None, None, "format chunk without a rate"
        elif name == b"data":
            if rate is None:
                return None, None, "data before a format chunk"
            if body + size > len(content):
                return None, None, "data chunk is cut"
            return rate, size // width, None
        at = body + size + size % 2
    return None, None, "no data chunk" if rate else "no format chunk"


def wav_header(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with sample_rate, duration_s (six decimals) and header_problem (null where the header is sound)."""

    @F.pandas_udf(HEADER)
    def read(column: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([riff_header(x) for x in column], columns=["rate", "frames", "problem"])
        return found.astype({"rate": "Int32", "frames": "Int64", "problem": "object"})

    h = df.withColumn("_header", read(F.col(content)))
    duration = F.bround(F.col("_header.frames").cast("double") / F.col("_header.rate"), 6)
    out = h.withColumn("sample_rate", F.col("_header.rate")).withColumn("duration_s", duration).withColumn("header_problem", F.col("_header.problem"))
    return out.drop("_header")


# ---- name parsers: corpus -> struct of ITEM_FIELDS, null where the name does not match -------
def _parsed(ok: Column, **cols: Column) -> Column:
    fields = [cols.get(n, F.lit("")).alias(n) for n in ITEM_FIELDS]
    return F.when(ok, F.struct(*fields))


def parse_ravdess(stem: Column) -> Column:
    g = lambda i: F.regexp_extract(stem, RAVDESS_STEM, i)
    raw = code_label(g(3), RAVDESS_CODES)
    return _parsed(
        stem.rlike(RAVDESS_STEM) & raw.isNotNull(), item_id=F.concat(F.lit("ravdess/"), stem),
        speaker_id=F.concat(F.lit("ravdess_"), g(7)), raw=raw,
    )


def parse_cremad(stem: Column) -> Column:
    g = lambda i: F.regexp_extract(stem, CREMAD_STEM, i)
    raw = code_label(g(3), CREMAD_CODES)
    return _parsed(
        stem.rlike(CREMAD_STEM) & raw.isNotNull(), item_id=F.concat(F.lit("cremad/"), stem),
        speaker_id=F.concat(F.lit("cremad_"), g(1)), raw=raw,
    )


def parse_iemocap(stem: Column) -> Column:
    """Session, subset and speaker from the id; the label comes from annotations."""
    g = lambda i: F.regexp_extract(stem, IEMOCAP_ID, i)
    subset = F.when(g(4) == "impro", "improvised").otherwise("scripted")
    return _parsed(
        stem.rlike(IEMOCAP_ID), item_id=F.concat(F.lit("iemocap/"), stem),
        speaker_id=F.concat(F.lit("iemocap_Ses"), g(1), g(5)), session_id=F.concat(F.lit("Ses"), g(1)), subset=subset,
    )


PARSERS: dict[str, Callable[[Column], Column]] = {
    "ravdess": parse_ravdess, "cremad": parse_cremad, "iemocap": parse_iemocap,
}
# Files a corpus ships that are not items: RAVDESS song channel.
SKIP: dict[str, Callable[[Column], Column]] = {
    "ravdess": lambda stem: F.coalesce(F.nullif(F.regexp_extract(stem, RAVDESS_STEM, 2), F.lit("")) != "01", F.lit(False)),
}


def parse_names(df: DataFrame, parsers: Mapping[str, Callable] = PARSERS, skip: Mapping[str, Callable] = SKIP) -> DataFrame:
    """Adds the item fields; ``parsed`` is false where a name does not match its corpus."""
    parsed, drop = F.lit(None), F.lit(False)
    for corpus, fn in parsers.items():
        parsed = F.when(F.col("corpus") == corpus, fn(F.col("stem"))).otherwise(parsed)
    for corpus, fn in skip.items():
        drop |= (F.col("corpus") == corpus) & fn(F.col("stem"))
    out = df.where(~drop).withColumn("_p", parsed)
    return out.select("*", *[F.col(f"_p.{n}").alias(n) for n in ITEM_FIELDS], F.col("_p").isNotNull().alias("parsed")).drop("_p")


def extract_fields(df: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """General form: capture groups of one pattern as columns, null where it does not match."""
    ok = F.col(column).rlike(pattern)
    return df.select("*", *[
        F.when(ok, F.regexp_extract(column, pattern, i + 1)).alias(n) for i, n in enumerate(names)
    ])


def parse_dirs(df: DataFrame, path: str, names: Mapping[str, int]) -> DataFrame:
    """Columns from directory levels; negative levels count from the end."""
    parts = F.split(path, "/")
    return df.select("*", *[F.try_element_at(parts, F.lit(i)).alias(n) for n, i in names.items()])


# ---- annotations -----------------------------------------------------------
def scan_annotations(
    spark: SparkSession, root: str, pattern: str = IEMOCAP_SUMMARY, codes: Mapping[str, str] = IEMOCAP_CODES,
    folder: str = "EmoEvaluation",
) -> DataFrame:
    """(item, code, raw, file) of every annotation line directly inside ``folder``.

    An unknown code leaves ``raw`` null; :func:`annotation_errors` reports it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
    lines = lines.select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"))
    here = lines.where(F.col("file").rlike(f"/{folder}/[^/]+$") & F.col("value").rlike(pattern))
    return here.select(
        F.regexp_extract("value", pattern, 1).alias("item"), F.regexp_extract("value", pattern, 2).alias("code"), "file"
    ).withColumn("raw", code_label(F.col("code"), codes))


def annotation_errors(notes: DataFrame) -> DataFrame:
    """Unknown codes and items with contradictory labels."""
    unknown = notes.where("raw IS NULL").select("item", F.concat(F.lit("unknown code "), F.col("code")).alias("problem"))
    g = notes.where("raw IS NOT NULL").groupBy("item").agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
    clash = g.where("a <> b").select("item", F.concat_ws(" and ", "a", "b").alias("problem"))
    return unknown.unionByName(clash)


def annotation_labels(notes: DataFrame) -> DataFrame:
    """One label per item; identical repeats fold."""
    return notes.where("raw IS NOT NULL").groupBy("item").agg(F.min("raw").alias("raw"))
