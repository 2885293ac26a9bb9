"""Document quality from supervised subword embeddings.

A document is the mean of learned vectors: each word (a run between ASCII white space, case and marks kept) is the
mean of the vectors of its hash and of the hashes of its character n-grams (bytes of the word between blanks), and
each pair of neighbouring words adds the vector of its hash; a word that repeats its predecessor adds one vector
of its own. A softmax over the mean gives the score. All vectors live in ``BUCKETS`` hashed rows.

Training is stochastic gradient descent in numpy on the driver, over a bounded sample of labelled rows outside the
held-out fold, weighted to the class shares of all labelled rows. Scoring reads each text whole without a shuffle,
embeds each distinct word of a chunk once, and ships only the embedding table (BUCKETS x DIMENSIONS floats).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.labelled import class_counts, fold, training_rows
from fathomark.llm.words import Flat, chunks, mix, split_words

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 8_000
BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 8, (3, 4)
EPOCHS, BATCH, RATE = 8, 32, 20.0
THRESHOLD = 0.3
_U = np.uint64
_REPEAT = 0


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIMENSIONS
    output: np.ndarray  # DIMENSIONS + 1 (the log odds of class 1; the last is the bias)
    share: float  # of class 1 in training; the score where nothing could be learned
    fitted: bool


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) % _U(BUCKETS - 1)).astype(np.int64) + 1


def _distinct(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, number of the word at each position)."""
    _, at, inverse = np.unique(flat.hashes, return_index=True, return_inverse=True)
    return at, inverse


def _word_grams(flat: Flat, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets in word order, buckets of each word) of the words at positions ``at``: whole words, then n-grams."""
    yield _bucket(flat.hashes[at]), np.ones(len(at), np.int64)
    start, size = flat.start[at], flat.end[at] - flat.start[at]
    first = np.concatenate([[0], np.cumsum(size + 2)])
    before = np.cumsum(size) - size
    text = np.full(int(first[-1]), 0x20, np.uint8)
    step = np.arange(int(size.sum()))
    text[np.repeat(first[:-1] + 1 - before, size) + step] = flat.data[np.repeat(start - before, size) + step]
    for n in GRAMS:
        each = np.maximum(size + 3 - n, 0)
        place = np.repeat(first[:-1] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        code = np.full(len(place), n, np.uint64)
        for k in range(n):
            code = code * _U(257) + text[place + k]
        yield _bucket(code), each


def _pairs(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each pair of neighbouring words, position of its second word)."""
    second = np.ones(len(flat.hashes), bool)
    second[flat.first[:-1][flat.counts > 0]] = False
    at = np.flatnonzero(second)
    a, b = flat.hashes[at - 1], flat.hashes[at]
    return np.where(a == b, _REPEAT, _bucket(a * _U(0x9E3779B97F4A7C15) + b)), at


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; an empty range sums to zero."""
    out = np.zeros((len(first) - 1, values.shape[1]), np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some], dtype=np.float64)
    return out


def document_vectors(flat: Flat, table: np.ndarray) -> np.ndarray:
    """The mean vector of each text; zeros where it has no words."""
    if not len(flat.hashes):
        return np.zeros((len(flat.counts), table.shape[1]))
    at, number = _distinct(flat)
    word, parts = np.zeros((len(at), table.shape[1])), np.zeros(len(at), np.int64)
    for buckets, each in _word_grams(flat, at):
        word += _sums(table[buckets], np.concatenate([[0], np.cumsum(each)]))
        parts += each
    word /= parts[:, None]
    pair, second = _pairs(flat)
    total = _sums(word[number], flat.first) + _sums(table[pair], np.searchsorted(second, flat.first))
    return total / np.maximum(2 * flat.counts - 1, 1)[:, None]


def _training_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, where each text's entries begin): the mean as a sparse product."""
    buckets, weights, sizes = [], [], []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        flat = split_words(raw, np.array([0, len(raw)]))
        n = len(flat.hashes)
        if not n:
            sizes.append(0)
            continue
        at, number = _distinct(flat)
        grams = list(_word_grams(flat, at))
        pair, _ = _pairs(flat)
        share = np.bincount(number, minlength=len(at)) / sum(each for _, each in grams)
        own, place = np.unique(np.concatenate([*(b for b, _ in grams), pair]), return_inverse=True)
        buckets.append(own)
        weights.append(np.bincount(place, np.concatenate([*(np.repeat(share, each) for _, each in grams), np.ones(len(pair))])) / max(2 * n - 1, 1))
        sizes.append(len(own))
    return np.concatenate(buckets), np.concatenate(weights), np.concatenate([[0], np.cumsum(sizes)])


def _descend(texts: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets, weights, first = _training_parts(texts)
    rng = np.random.default_rng(11)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output = np.zeros(DIMENSIONS + 1)
    output[:-1] = rng.normal(0, 1, DIMENSIONS)
    weight = weight / weight.mean()
    steps = EPOCHS * -(-len(texts) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            rows = order[lo : lo + BATCH]
            size = first[rows + 1] - first[rows]
            take = np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            owner = np.repeat(np.arange(len(rows)), size)
            b, w = buckets[take], weights[take]
            part = table[b] * w[:, None]
            mean = np.stack([np.bincount(owner, part[:, d], len(rows)) for d in range(DIMENSIONS)], 1)
            p = 1 / (1 + np.exp(-np.clip(mean @ output[:-1] + output[-1], -30, 30)))
            error = weight[rows] * (p - y[rows]) / len(rows)
            back = error[:, None] * output[:-1]
            output -= rate * 0.05 * np.r_[mean.T @ error, error.sum()]
            spread = back[owner] * w[:, None]
            for d in range(DIMENSIONS):
                table[:, d] -= rate * np.bincount(b, spread[:, d], BUCKETS)
    return table.astype(np.float32), output


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``rows`` labelled texts of each class, of up to ``chars`` characters."""
    sample = training_rows(docs, labels, "quality", folds, held_out, (rows, rows), chars)
    counts = class_counts(labels, "quality", folds, held_out)
    share = counts[1] / sum(counts) if sum(counts) else 0.5
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], float)
    if not any(t.split() for t in texts) or len(set(y.tolist())) < 2:
        return Model(np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros(DIMENSIONS + 1), share, False)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    return Model(*_descend(texts, y, weight), share, True)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = [np.zeros(0)]
    for lo, hi, data, offsets in chunks(column):
        if model.fitted:
            mean = document_vectors(split_words(data, offsets), model.table)
            out.append(1 / (1 + np.exp(-np.clip(mean @ model.output[:-1] + model.output[-1], -30, 30))))
        else:
            out.append(np.full(hi - lo, model.share))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, whole texts; other columns are ignored.

    Null, empty and blank texts have the zero vector and so the score of the bias alone. A null id is in no fold.
    Where no labelled row of one class can be learned from, every score is the share of class 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), model))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
