"""Toxicity by compression distance: windows compressed with a toxic and with an ordinary zstandard dictionary.

Fitting, on a bounded sample of labelled rows outside the held-out fold:

1. Character n-grams inside words are counted by the distinct contexts (word before, word, word after) they
   occur in, so that copies of a text count once. N-grams far more frequent in toxic texts mark spans of words;
   the spans, the longest variants first and the most frequent last, are the toxic text.
2. The ordinary dictionary is trained on windows of ordinary texts. The toxic dictionary is the same content
   with the toxic text behind it, so that windows without toxic spans compress alike with both.
3. A window's distance is its ordinary minus its toxic compressed length. The largest distances of a text and
   the numbers of windows above fixed distances, against the number of all its windows, go into a logistic
   regression weighted to the class shares of all labelled rows: the calibrated thresholds.

Scoring reads each text whole, window by window, with no shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.bpe import text_batches
from fathomark.llm.labelled import class_counts, fold, training_rows

FOLDS, HELD_OUT = 4, 2
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1200, 2400, 12_000
WINDOW_WORDS, WORD_CHARS = 6, 64
GRAM, LEAST_CONTEXTS, LEAST_LOG_RATIO = 5, 20, 3.0
VARIANT_SHARES = (0.5, 0.12)
ORDINARY_BYTES, TOXIC_BYTES, PRIMER_BYTES = 1024, 4096, 40
THRESHOLD = 0.3
_DISTANCES = (1, 2, 3, 4, 5)


def window_texts(text: str, width: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive windows that cover a text; longer words than WORD_CHARS are cut into several."""
    words = (text or "").lower().split()
    if any(len(w) > WORD_CHARS for w in words):
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return [f" {' '.join(words[i : i + width])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), width)]


def _context_counts(texts: list[str]) -> tuple[Counter, int]:
    """How many distinct contexts hold each n-gram, and how many contexts there are."""
    words_in: Counter = Counter()
    seen: set[int] = set()
    for text in texts:
        words = ["", *text.lower().split(), ""]
        for context in zip(words, words[1:], words[2:]):
            key = hash(context)
            if key not in seen:
                seen.add(key)
                words_in[context[1]] += 1
    counts: Counter = Counter()
    for word, n in words_in.items():
        padded = f" {word} "
        for gram in {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}:
            counts[gram] += n
    return counts, len(seen)


def _spans(word: str, grams: set[str], counts: Counter, share: float) -> set[str]:
    """Maximal spans of a word under marked n-grams that are frequent beside the most frequent one."""
    padded = f" {word} "
    at = [i for i in range(len(padded) - GRAM + 1) if padded[i : i + GRAM] in grams]
    if not at:
        return set()
    most = max((counts[padded[i : i + GRAM]] for i in at), default=0)
    covered = np.zeros(len(padded) + 2, np.int8)
    for i in at:
        if counts[padded[i : i + GRAM]] >= most * share:
            covered[i + 1 : i + 1 + GRAM] = 1
    edge = np.flatnonzero(np.diff(covered))
    return {padded[a:b] for a, b in zip(edge[::2], edge[1::2])}


def toxic_text(toxic: list[str], ordinary: list[str]) -> bytes:
    """The spans that mark toxic texts, the most frequent last (nearest to the window)."""
    count_t, n_t = _context_counts(toxic)
    count_o, n_o = _context_counts(ordinary)
    ratio = {g: math.log((n + 0.5) / (n_t + 1)) - math.log((count_o[g] + 0.5) / (n_o + 1)) for g, n in count_t.items() if n >= LEAST_CONTEXTS}
    grams = {g for g, r in ratio.items() if r > LEAST_LOG_RATIO}
    found: Counter = Counter()
    spans: dict[str, list[set[str]]] = {}
    for text in toxic:
        words = set(text.lower().split())
        for word in words.difference(spans):
            spans[word] = [_spans(word, grams, count_t, share) for share in VARIANT_SHARES]
        for k in range(len(VARIANT_SHARES)):
            found.update({s for w in words for s in spans[w][k]})
    out = b""
    for span, n in sorted(found.items(), key=lambda kv: (-kv[1], kv[0])):
        raw = span.encode("utf-8", "surrogatepass")
        if n < 2 or len(out) + len(raw) > TOXIC_BYTES:
            break
        if raw not in out:
            out = raw + out
    return out


@dataclass
class Model:
    """Dictionary contents and the fitted weights; ``weights`` is empty where nothing could be fitted."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float


class Distances:
    """Compressors of a model; one for each task."""

    def __init__(self, model: Model) -> None:
        self.primer = model.ordinary[-PRIMER_BYTES:]
        self.compressors = [self._compressor(c) for c in (model.ordinary, model.ordinary + model.toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_LAZY2, min_match=4, window_log=15, chain_log=14, hash_log=14, search_log=4, target_length=16,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def of(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0, np.int64)
        # The primer is known to both dictionaries: a block is then compressed whatever the window holds.
        full = [self.primer + w for w in windows]
        plain, toxic = (np.fromiter((len(s) for s in c.multi_compress_to_buffer(full)), np.int64, len(full)) for c in self.compressors)
        return plain - toxic

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: two largest distances, log of windows, log counts above fixed distances."""
        windows = [window_texts(t or "") for t in texts]
        distance = self.of([w for ws in windows for w in ws])
        rows, at = np.zeros((len(texts), 3 + len(_DISTANCES))), 0
        for row, ws in zip(rows, windows):
            own = distance[at : at + len(ws)]
            at += len(ws)
            if len(own):
                top = np.sort(own)[-2:][::-1]
                row[0], row[1] = min(top[0], 8), min(top[1], 8) if len(top) > 1 else 0
            row[2] = math.log1p(len(own))
            row[3:] = [math.log1p(int((own >= d).sum())) for d in _DISTANCES]
        return rows


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on the weighted, slightly ridged log loss; the last column of ``x`` is constant."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-4
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / weight.sum() + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """Fit on at most ``toxic_rows`` and ``ordinary_rows`` labelled texts of up to SAMPLE_CHARS characters."""
    rows = training_rows(docs, labels, "toxic", folds, held_out, (ordinary_rows, toxic_rows), SAMPLE_CHARS)
    counts = class_counts(labels, "toxic", folds, held_out)
    share = counts[1] / max(1, sum(counts))
    toxic, ordinary = ([t for t, y in rows if y == value] for value in (1, 0))
    samples = [w for t in ordinary for w in window_texts(t)]
    empty = Model(b"", b"", np.zeros(0), np.ones(0), np.zeros(0), share)
    if len(toxic) < 8 or len(samples) < 64:
        return empty
    try:
        content = zstd.train_dictionary(4 * ORDINARY_BYTES, samples).as_bytes()[-ORDINARY_BYTES:]
    except zstd.ZstdError:  # too little text to train on
        content = b"".join(samples)[-ORDINARY_BYTES:]
    model = Model(content, toxic_text(toxic, ordinary), empty.mean, empty.scale, empty.weights, share)
    x, y = Distances(model).features([t for t, _ in rows]), np.array([y for _, y in rows], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, counts[1] / len(toxic), counts[0] / len(ordinary))
    model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y, weight)
    return model


def _score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model) if len(model.weights) else None
        for batch in batches:
            scores = [np.zeros(0)]
            for texts in text_batches(batch.column("text")):
                if distances is None:
                    scores.append(np.full(len(texts), model.share))
                else:
                    x = (distances.features(texts) - model.mean) / model.scale
                    scores.append(1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -30, 30))))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(scores))], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, whole texts; other columns are ignored.

    Null and empty texts have no windows and still get a score. A null id is in no fold: held_out is false.
    Where fewer than eight toxic rows can be learned from, every score is the share of toxic rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score_rows(model), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _score_rows(model)
        for batch in batches:
            table = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])
            kept = [out.column("score").to_numpy() < threshold for out in scorer(iter([table]))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
