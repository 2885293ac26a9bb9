"""Filter interaction audit: what five filters remove, in every order, from one pass over the texts.

1. One pass measures each text: the filters A to D as bits, and a 128-bit hash of the text.
2. Filter E (an equal text has a smaller id) is an existential self-join. Hashes seen under one id only are put aside
   first. Of the rest, every (hash, text) keeps its smallest id, and a left-semi join on hash, exact text and smaller
   id marks the copies. A group of copies meets one row, so it costs its length.
3. The ids E marks are united with the failures of the other filters and folded into one bit combination per document.
4. Documents are counted by part and combination: at most 32 counts a part. What each order keeps and removes at each
   step follows from these counts alone; the orders are a literal of 600 entries, so no document meets an order.

Counts combine map side; a hot source, label or text is a few rows per task after that. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.words import chunks, split_words
from fathomark.sources.scratch import materialise

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("bits", pa.int32()), ("hash", pa.binary())])


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4, 8 of each text: too short, repetitive, too many capitals, a forbidden mark."""
    texts = len(offsets) - 1
    flat = split_words(data, offsets)
    words = flat.counts
    # The text's number in the upper bits, the word's hash in the rest (42 bits or more): one sort counts distinct words.
    width = np.uint64(64 - max(1, int(texts).bit_length()))
    owner = np.repeat(np.arange(texts, dtype=np.uint64), words)
    values = np.sort((owner << width) | (flat.hashes >> (np.uint64(64) - width)))
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    distinct = np.bincount((values[new] >> width).astype(np.int64), minlength=texts)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    points = count((data & 0xC0) != 0x80)
    capitals = count((data >= 0x41) & (data <= 0x5A))
    marked = count(MARKS[data]) > 0
    return (words < 200) * 1 + (100 * distinct < 50 * words) * 2 + (100 * capitals > 2 * points) * 4 + marked * 8


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            bits = failures(data, offsets).astype(np.int32)
            digest = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("part").slice(lo, hi - lo), pa.array(bits), pa.array(digest, pa.binary())], schema=FACTS)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            digest = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "part", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digest, pa.binary())], names=["doc_id", "part", "text", "hash"])


def copies(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a smaller id has. ``texts``: doc_id, part, text; ``facts``: doc_id, hash of each row."""
    seen = facts.filter("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = materialise(seen.filter("first < last").select("hash"), "audit-hashes")
    hashed = texts.filter("doc_id is not null").mapInArrow(_hashes, "doc_id long, part string, text string, hash binary")
    group = materialise(hashed.join(repeated, "hash", "left_semi"), "audit-copies")
    first = group.groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    first = materialise(first.select(F.col("hash").alias("first_hash"), F.col("text").alias("first_text"), "first"), "audit-first")
    same = (F.col("hash") == F.col("first_hash")) & (F.col("text") == F.col("first_text")) & (F.col("first") < F.col("doc_id"))
    return group.join(first, same, "left_semi").select("doc_id", "part", "hash")


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it)."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the filters they fail."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    facts = materialise(texts.select("doc_id", "part", "text").mapInArrow(_facts, "doc_id long, part string, bits int, hash binary"), "audit-facts")
    row = ["doc_id", "part", "hash"]
    marked = copies(texts, facts).select(*row, F.lit(COPY).alias("bits"), F.lit(0).alias("rows"))
    united = facts.select(*row, "bits", F.lit(1).alias("rows")).unionByName(marked)
    folded = united.groupBy(*row).agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("n"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    good, toxic = (F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))
    return folded.join(flags, "doc_id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), good, toxic)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, with the counts of documents at that step.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. Filters: A under 200 words, B fewer than half of
    the words distinct, C capitals over 2 % of the code points, D a mark of ``#$%&*|``, E the text of a smaller doc_id.
    Null texts are empty (and equal to other empty texts), a null source is the part ''. Rows with a null id are counted
    but neither are nor have copies. Rows that share an id count one each and are no copies of each other. Repeated
    labels of an id count if any says so. An empty table gives no rows. Other columns are ignored.
    """
    by_part = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts"))
    order = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in _steps()])
    rows = by_part.select("part", "counts", F.explode(order).alias("o")).select("part", "counts", "o.*")

    def total(column: str, condition) -> F.Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(condition(c["bits"]), c[column]).otherwise(F.lit(0)))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda b: b.bitwiseAND(bit) != 0
    gone = lambda b: b.bitwiseAND(before) != 0
    removed = lambda b: fails(b) & ~gone(b)
    # A filter removes a document in 1 of k orders of the k filters that it fails, and there are 120 orders.
    share = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["bits"]), c["n"] * (F.lit(120) / F.bit_count(c["bits"])).cast("long")).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda b: ~fails(b) & ~gone(b)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda b: fails(b) & gone(b)).alias("redundant"),
        total("n", lambda b: b == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
