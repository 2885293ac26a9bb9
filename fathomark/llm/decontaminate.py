"""Benchmark decontamination with DataFrame functions only.

Words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased. A benchmark
item contributes its windows of ``length`` consecutive words; an item with fewer words is one window.

1. Each benchmark window names its longest pair of neighbouring words. The hashes of these pairs are a constant
   set in the scan: a document without any of them holds no window. One pass over all texts counts the words and
   keeps the texts that may hit.
2. Every window of those texts is hashed where it is read and looked up in a broadcast hash set of the benchmark
   windows; hits are verified against the words themselves. Only verified hits are shuffled.

The scan folds case by ``lower``, which merges all that the exact rule merges and perhaps more and leaves the word
boundaries; the verification uses the exact rule. The set is broadcast after a count: up to
``broadcast_windows`` windows (about 200 bytes each with its words). Beyond, the pairs are not used and the same
join shuffles; the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomark.llm.names import free_names
from fathomark.sources.scratch import materialise

LENGTH = 13
BROADCAST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _windows(text: Column, lengths: list[int]) -> Column:
    """All windows of the given lengths as an array of (pos, len, hash); positions count from 1.

    The words are an element of a one-element array, so that the lambda over positions refers to a value and not
    to the expression that splits the text.
    """
    return F.transform(F.array(_words(text)), lambda words: _windows_of(words, lengths))[0]


def _windows_of(words: Column, lengths: list[int]) -> Column:
    def of(n: int) -> Column:
        last = F.size(words) - (n - 1)
        some = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice(words, i, n)).alias("hash")))
        return F.when(last >= 1, some).otherwise(F.array().cast("array<struct<pos:int,len:int,hash:bigint>>"))

    parts = [of(n) for n in lengths]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _text(words: Column, pos: Column, size: Column) -> Column:
    return F.translate(F.array_join(F.slice(words, pos, size), " "), UPPER, LOWER)


def benchmark_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(hash, window, len, item_ids) of each distinct benchmark window."""
    words = items.select("item_id", _words(F.col("text")).alias("exact"), _words(F.lower("text")).alias("folded")).filter(F.size("exact") > 0)
    size = F.least(F.size("exact"), F.lit(length))
    starts = words.select("item_id", "exact", "folded", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("exact") - size + 1)).alias("pos"))
    rows = starts.select("item_id", "len", F.xxhash64(F.slice("folded", F.col("pos"), F.col("len"))).alias("hash"), _text(F.col("exact"), F.col("pos"), F.col("len")).alias("window"))
    return rows.groupBy("hash", "len", "window").agg(F.collect_set("item_id").alias("item_ids"))


def _pairs(words: Column) -> Column:
    """A hash of each pair of neighbouring words."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def scan(docs: DataFrame, items: DataFrame, length: int = LENGTH, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, version and n_words; the verified hits: doc_id, version, pos, len, item_ids).

    ``version`` is a hash of the text.
    """
    windows = materialise(benchmark_windows(items, length), "benchmark-windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [length]  # at most `length` values
    few = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    may_hit = lambda words: F.lit(True)
    if few and lengths[0] > 1:
        folded = F.split(F.lower("window"), " ")
        longest = F.array_max(F.zip_with(folded, F.slice(folded, 2, F.size(folded) - 1), lambda a, b: F.struct((F.length(a) + F.length(b)).alias("n"), F.xxhash64(a, b).alias("pair"))))["pair"]
        marks = [str(r["pair"]) for r in windows.select(longest.alias("pair")).distinct().collect()]  # bounded by the count above
        known_pairs = (F.split(F.lit(",".join(marks)), ",") if marks else F.array()).cast("array<bigint>")
        may_hit = lambda words: F.arrays_overlap(_pairs(words), known_pairs)
    look = F.transform(F.array(_words(F.lower("text"))), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), F.coalesce(may_hit(words), F.lit(False)).alias("may_hit")))[0]
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text", look.alias("look"))
    rows = rows.select("doc_id", "version", F.col("look")["n_words"].alias("n_words"), F.when(F.col("look")["may_hit"], F.col("text")).alias("text"))
    rows = materialise(rows, "benchmark-scan")

    known = windows.withColumnsRenamed({"hash": "known_hash", "len": "known_len"})
    known = F.broadcast(known) if few else known
    places = rows.filter("text is not null").select("doc_id", "version", "text", _windows(F.lower("text"), lengths).alias("windows")).select("doc_id", "version", "text", F.inline("windows"))
    exact = _text(_words(F.col("text")), F.col("pos"), F.col("len"))
    # Two inequalities, so that the words are compared after the hashes met and are not a join key themselves.
    same = (F.col("hash") == F.col("known_hash")) & (exact >= F.col("window")) & (exact <= F.col("window"))
    return rows.select("doc_id", "version", "n_words"), places.join(known, same).select("doc_id", "version", "pos", "len", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, percent: int = 5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, version, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least one word is hit and the hit words are ``percent`` of its words or
    more. Null and empty texts have no words. Every row comes back, rows with a null id or a shared id too;
    rows with the same id are told apart by their text. An item with a null id marks words but is not counted
    or listed. Other columns are ignored. An empty benchmark hits nothing.
    """
    all_docs, found = scan(docs.select("doc_id", "text"), items.select("item_id", "text"), length, broadcast_windows)
    spans = F.array_sort(F.collect_set(F.struct("pos", "len")))
    doc = found.groupBy("doc_id", "version").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, span: Column) -> Column:
        end = span["pos"] + span["len"]
        new = F.greatest(end - F.greatest(acc["next"], span["pos"]), F.lit(0))
        return F.struct(F.greatest(acc["next"], end).alias("next"), (acc["n"] + new).cast("long").alias("n"))

    doc = doc.select(
        F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version"), F.aggregate("spans", start, cover)["n"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
    )
    out = all_docs.join(doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "version", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH, percent: int = 5) -> DataFrame:
    """``docs``, all columns, without the contaminated rows."""
    bad_id, bad_version = free_names(docs.columns, "bad_id", "bad_version")
    bad = contamination(docs, items, length, percent).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("version").alias(bad_version)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(docs["text"]) == bad[bad_version]), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with hit words removed from the texts; a text without hits stays as it is.

    In a text that loses words the words that stay, with their case, are joined by one space. Rows with a null id or a
    shared id are judged by their own text, repeated rows alike; a null or empty text stays.
    """
    hit_id, hit_version, hit_spans = free_names(docs.columns, "hit_id", "hit_version", "hit_spans")
    spans = scan(docs.select("doc_id", "text"), items.select("item_id", "text"), length)[1].groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", "len")).alias(hit_spans))
    spans = spans.withColumnsRenamed({"doc_id": hit_id, "version": hit_version})
    out = docs.join(spans, docs["doc_id"].eqNullSafe(spans[hit_id]) & (F.xxhash64(docs["text"]) == spans[hit_version]), "left")
    gone = F.flatten(F.transform(spans[hit_spans], lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    words = _words(docs["text"])
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size(words)), gone), lambda i: F.element_at(words, i))
    text = F.when(spans[hit_spans].isNull(), docs["text"]).otherwise(F.array_join(left, " "))
    return out.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
