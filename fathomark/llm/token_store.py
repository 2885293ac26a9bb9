"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is one self-contained block of bytes (format below), held as a row of a Parquet dataset, so that any
store Spark can write to will do. Documents lie in ascending id order over all shards.

    magic "FTS1" | u32 documents | u32 buckets | u32 id width | u64 tokens | u64 tokens before, in the partition
    i64 doc_id[documents]        in file order
    i32 pilot[buckets]           displacement of a bucket; negative: the slot itself, for single keys
    u32 fingerprint[documents]   by slot
    u32 row[documents]           by slot: position in file order
    u64 offset[documents + 1]    in tokens, by file order
    u16 or u32 payload[tokens]   raw ids, the narrower width when the vocabulary allows it

``Shard.get(doc_id)`` hashes the key, reads one pilot, one fingerprint and one row, and slices the payload:
constant time, whatever the shard's size. A key that was never stored fails the fingerprint (or the stored
key, compared last).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomark.llm.bpe import pieces, text_batches
from fathomark.llm.words import mix
from fathomark.sources.scratch import shared_dir

SHARD_TOKENS = 1 << 20
BUCKET = 4
MEMORY_PIECES = 800_000
LINE_WORDS = 256
_MAGIC = b"FTS1"
_HEAD = struct.Struct("<4sIIIQQ")
_U = np.uint64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(np.asarray(keys, np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))


def _slot(h: np.ndarray, pilot, n: int) -> np.ndarray:
    return (mix(h ^ (np.asarray(pilot, np.uint64) * _U(0xD6E8FEB86659FD93))) % _U(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each key) of distinct keys: hash into buckets, displace the large buckets first."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET))
    pilots, slots = np.zeros(buckets, np.int32), np.zeros(n, np.int64)
    if n == 0:
        return pilots, slots
    bucket = (_hash(keys, 0) % _U(buckets)).astype(np.int64)
    h = _hash(keys, 1)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(first)
    free = np.ones(n, bool)
    for b in np.argsort(-size, kind="stable").tolist():
        if size[b] <= 1:
            break
        rows = order[first[b] : first[b + 1]]
        pilot, tried = 0, 64
        while True:
            # A stretch of pilots at once; the least one whose slots are free and distinct is taken.
            at = _slot(h[rows], np.arange(pilot, pilot + tried)[:, None], n)
            fits = np.flatnonzero(free[at].all(1))
            if len(fits):
                fits = fits[(np.diff(np.sort(at[fits], 1), axis=1) > 0).all(1)]
            if len(fits):
                break
            pilot, tried = pilot + tried, min(2 * tried, 4096)
        free[at[fits[0]]] = False
        slots[rows], pilots[b] = at[fits[0]], pilot + fits[0]
    # Buckets of one key take the free slots directly.
    left = iter(np.flatnonzero(free).tolist())
    for b in np.flatnonzero(size == 1).tolist():
        at = next(left)
        slots[order[first[b]]], pilots[b] = at, -at - 1
    return pilots, slots


def pack(doc_ids: list[int], rows: list[np.ndarray], before: int, width: int) -> bytes:
    """The bytes of a shard. Ids may repeat: the first row of an id is the one that keyed access finds."""
    ids = np.array(doc_ids, np.int64)
    offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("<u8")
    keys, where = np.unique(ids, return_index=True)
    pilots, slots = perfect_hash(keys)
    fingerprint, row = np.zeros(len(ids), "<u4"), np.zeros(len(ids), "<u4")
    fingerprint[slots] = (_hash(keys, 2) >> _U(32)).astype(np.uint32)
    row[slots] = where
    head = _HEAD.pack(_MAGIC, len(ids), len(pilots), width, int(offset[-1]), before)
    payload = np.concatenate(rows).astype(f"<u{width}") if rows else np.zeros(0, f"<u{width}")
    return b"".join([head, ids.astype("<i8").tobytes(), pilots.astype("<i4").tobytes(), fingerprint.tobytes(), row.tobytes(), offset.tobytes(), payload.tobytes()])


class Shard:
    """A view of a shard's bytes; nothing is copied until ids are read."""

    def __init__(self, raw: bytes) -> None:
        magic, self.n, buckets, width, self.tokens, self.before = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.pilots = take("<i8", self.n), take("<i4", buckets)
        self.fingerprint, self.row, self.offset = take("<u4", self.n), take("<u4", self.n), take("<u8", self.n + 1)
        self.payload = take(f"<u{width}", self.tokens)
        self._distinct: int | None = None

    @property
    def distinct(self) -> int:
        """The number of slots: distinct ids."""
        if self._distinct is None:
            self._distinct = self.n if self.n < 2 or (np.diff(self.doc_ids) > 0).all() else len(np.unique(self.doc_ids))
        return self._distinct

    def find(self, keys: np.ndarray) -> np.ndarray:
        """File positions of the keys, -1 where a key is not stored."""
        keys = np.asarray(keys, np.int64)
        if not self.n:
            return np.full(len(keys), -1)
        bucket = (_hash(keys, 0) % _U(len(self.pilots))).astype(np.int64)
        pilot = self.pilots[bucket].astype(np.int64)
        slot = np.where(pilot < 0, -pilot - 1, _slot(_hash(keys, 1), np.maximum(pilot, 0), self.distinct))
        row = self.row[slot].astype(np.int64)
        good = (self.fingerprint[slot] == (_hash(keys, 2) >> _U(32)).astype(np.uint32)) & (self.doc_ids[row] == keys)
        return np.where(good, row, -1)

    def ids(self, row: int) -> np.ndarray:
        return self.payload[int(self.offset[row]) : int(self.offset[row + 1])].astype(np.uint32)

    def get(self, doc_id: int) -> np.ndarray | None:
        row = int(self.find(np.array([doc_id]))[0])
        return None if row < 0 else self.ids(row)


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores belong to its tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class LibraryEncoder:
    """The tokenizers library over the distinct pieces between white space, remembered up to a bound.

    The vocabulary's normaliser and splitter never join text across white space, lower-case all text and part a
    run of marks from a letter or digit before it. So a text's ids are the ids of its pieces in order, ASCII pieces
    that differ in case are one, and the marks at the end of one are encoded apart. Other pieces go to the library
    as they stand: it composes characters before it folds case, and the two do not commute. Pieces of letters are
    encoded many in a line and parted at the ids that end a word. The first ``memory`` pieces stay; later ones are
    encoded again for each batch that holds them.
    """

    def __init__(self, path: str, memory: int = MEMORY_PIECES) -> None:
        self.tokenizer, self.memory = _library(path), memory
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for text, i in vocab.items() if suffix and text.endswith(suffix)]] = True

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The library's ids of each part, as bytes."""
        words = [p for p in parts if p.isalpha()]
        found = self._words(words)
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, self._each(rest)))
        return [found[p] for p in parts]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, a line of them at a time.

        A word of letters has one end of a word or more, so a line with as many ends as words is parted at them;
        words of other lines are left out.
        """
        groups = [words[k : k + LINE_WORDS] for k in range(0, len(words), LINE_WORDS)]
        found: dict[str, bytes] = {}
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(stops) == len(group):
                raw, stops = ids.tobytes(), stops.tolist()
                found.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        return found

    def _each(self, parts: list[str]) -> list[bytes]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64) * self.width
        raw = np.fromiter(chain.from_iterable(lists), self.kind).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known, as bytes; kept while there is room."""
        # Special strings are matched before case is folded, so pieces that may hold one stay whole.
        simple = [p for p in new if p.isascii() and "<|" not in p]
        folded = "\n".join(simple).lower().split("\n") if simple else []  # no piece holds a line feed
        stems = [x if x[-1].isalnum() else (y if (y := x.rstrip(punctuation))[-1:].isalnum() else x) for x in folded]
        tails = [x[len(y) :] for x, y in zip(folded, stems)]
        known = self.known
        unknown = [*{*stems, *tails, *new.difference(simple)}.difference(known, ("",))]
        found = dict(zip(unknown, self._ids(unknown))) if unknown else {}
        for piece, stem, tail in zip(simple, stems, tails):
            ids = found[stem] if stem in found else known[stem]
            found[piece] = ids + (found[tail] if tail in found else known[tail]) if tail else ids
        if len(known) < self.memory:
            known |= found
        return found

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
        rows = [pieces(t or "") for t in texts]
        new = set().union(*rows).difference(self.known) if rows else set()
        held = self._learn(new) if new else {}
        known = self.known
        get = (known if new <= known.keys() else {p: known[p] if p in known else held[p] for p in set().union(*rows)}).__getitem__
        end = np.array([end_id], self.kind).tobytes()
        for row in rows:
            yield np.frombuffer(b"".join([*map(get, row), end]), self.kind).astype(np.uint32)


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    """One for all tasks of a Python worker."""
    return LibraryEncoder(path)


SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("shard", pa.binary())])


def _shard_rows(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(path)
        doc_ids: list[int] = []
        rows: list[np.ndarray] = []
        held = before = 0

        def shard() -> pa.RecordBatch:
            raw = pack(doc_ids, rows, before, encoder.width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())], schema=SHARD_SCHEMA)

        for batch in batches:
            at = 0
            ids = batch.column("doc_id").to_pylist()
            for texts in text_batches(batch.column("text")):
                for row in encoder.encode(texts, end_id):
                    if rows and held + len(row) > shard_tokens:
                        yield shard()
                        before += held
                        doc_ids, rows, held = [], [], 0
                    doc_ids.append(ids[at])
                    rows.append(row)
                    held += len(row)
                    at += 1
        if rows:
            yield shard()

    return run


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards under ``folder``, in ascending id order.

    Null texts are empty (only the end id). Rows with a null id have no key and are left out. Rows that share
    an id are all stored, in the order of their texts. A range partition and a sort within it give the order;
    a task holds one shard of ``shard_tokens`` tokens, or one longer document.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(_shard_rows(path, end_id, shard_tokens), "part int, tokens long, shard binary")
    # Small row groups let readers take a few shards each.
    shards.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(folder)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, value in zip(batch.column("part").to_pylist(), batch.column("shard")):
            shard = Shard(value.as_buffer().to_pybytes())
            found = shard.find(shard.doc_ids)
            if (found < 0).any():
                raise ValueError("a stored key is not found through its index")
            # Ids that repeat: keyed access gives their first row; the others are read by position.
            again = np.flatnonzero(np.r_[False, shard.doc_ids[1:] == shard.doc_ids[:-1]])
            found[again] = again
            start = shard.offset[found].astype(np.int64)
            count = shard.offset[found + 1].astype(np.int64) - start
            crc = [zlib.crc32(shard.ids(r).astype("<u4")) for r in found.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(shard.n, part, np.int32)), pa.array(shard.doc_ids), pa.array(start + shard.before), pa.array(count), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, through the index of its shard.

    ``start`` counts the ids of all documents before it; a shard knows the count within its partition, and the
    totals of the partitions (one number each) are summed up in order.
    """
    shards = spark.read.parquet(folder)
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = shards.select("part", "shard").mapInArrow(_read_rows, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, folder: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of keys: each shard answers in constant time per key."""
    wanted = np.array(keys, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("shard"):
                shard = Shard(value.as_buffer().to_pybytes())
                rows = shard.find(wanted)
                hit = np.flatnonzero(rows >= 0)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(wanted[hit]), pa.array([shard.ids(r).tolist() for r in rows[hit].tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.parquet(folder).select("shard").mapInArrow(run, "doc_id long, ids array<long>")


def store_and_read(docs: DataFrame, path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to a fresh folder under ``spark.checkpoint.dir`` and read every document back."""
    folder = shared_dir(docs.sparkSession, "token-shards")
    write_shards(docs, folder, path, end_id, shard_tokens)
    return read_documents(docs.sparkSession, folder)
