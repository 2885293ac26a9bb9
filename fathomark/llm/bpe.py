"""Byte-pair encoding and decoding in batched numpy merge rounds, from a public vocabulary file.

The file names a normaliser (canonical composition, white space to one blank, lower case), a splitting pattern,
the byte alphabet, the end-of-word suffix, the merges and special strings. Texts are cut at white space; each
distinct piece is encoded once while it stays in the worker's bounded memory. All new pieces of a batch are
encoded together: their symbols stand in one flat array, a binary search over the sorted pair keys ranks every
neighbouring pair, and each round merges the lowest-ranked pair of every word at once.

Nothing is shuffled or collected; a task holds one batch, one text's ids and ``MEMORY_PIECES`` pieces.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY_PIECES = 200_000
_NO_RANK = np.iinfo(np.int64).max


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """The tables of a vocabulary file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["unk_token"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not the kind of vocabulary this encoder reads")
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.strings = [""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in [*ids.items(), *special.items()]:
            self.strings[i] = text
        alphabet = _byte_alphabet()
        self.byte = np.array([ids[c] for c in alphabet], np.int64)
        self.last_byte = np.array([ids[c + suffix] for c in alphabet], np.int64)
        self.size = len(self.strings)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        if len(set(made.tolist())) != len(made):
            raise ValueError(f"{path}: two merges make one symbol, so equal pairs may not merge together")
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank], made[self.rank]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, where each word's ids begin, length words + 1) of non-empty words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.byte[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last_byte[raw[ends]]
        out_symbols, out_word = [], []
        while len(symbols):
            rank, found = self._ranks(symbols, word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            lowest = np.repeat(best, np.diff(np.r_[first, len(word)]))
            # Words without a mergeable pair are done and leave the array.
            done = lowest == _NO_RANK
            if done.any():
                out_symbols.append(symbols[done])
                out_word.append(word[done])
                symbols, word, rank, found, lowest = (x[~done] for x in (symbols, word, rank, found, lowest))
                if not len(symbols):
                    break
            hit = rank == lowest
            # In a run such as "aaa" the pairs overlap: every second one merges, from the left.
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            symbols[at] = self.made[found[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols = np.concatenate(out_symbols) if out_symbols else np.zeros(0, np.int64)
        word = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.searchsorted(word[order], np.arange(len(words) + 1))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the pair that begins at each symbol, and its row in the pair table."""
        rank = np.full(len(symbols), _NO_RANK)
        found = np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        key = symbols[inside] * self.size + symbols[inside + 1]
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[row] == key
        rank[inside[known]] = self.rank[row[known]]
        found[inside[known]] = row[known]
        return rank, found

    def decode(self, ids: np.ndarray) -> str:
        """Symbols joined by one blank, special strings and word-end marks kept."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lowered(text: str) -> str:
    """Lower case character by character: a final capital sigma is not treated apart."""
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


_WHITE = regex.compile(r"\s+")
_NOT_WHITE = regex.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """Runs between white space; the information separators, which ``str.split`` also cuts at, are not."""
    if _NOT_WHITE.search(text):
        return [p for p in _WHITE.split(text) if p]
    return text.split()


class Encoder:
    """Encodes texts with a bounded memory of pieces."""

    def __init__(self, vocab: Vocabulary, memory: int = MEMORY_PIECES) -> None:
        self.vocab, self.memory = vocab, memory
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        words: list[bytes] = []
        counts = np.zeros(len(new), np.int64)
        for k, piece in enumerate(new):
            found = [m.encode("utf-8", "surrogatepass") for m in self.vocab.pattern.findall(piece)]
            counts[k] = len(found)
            words += found
        flat, begin = self.vocab.encode_words(words) if words else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        bounds = begin[np.r_[0, np.cumsum(counts)]]
        base = len(self.ids)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, base + bounds[1:]])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        parts: list[list] = []
        for text in texts:
            row: list = []
            pattern = self.vocab.special_pattern
            for k, part in enumerate(pattern.split(text) if text and pattern and pattern.search(text) else [text or ""]):
                row.append(self.vocab.special[part] if k % 2 else pieces(lowered(unicodedata.normalize("NFC", part))))
            parts.append(row)
        if len(self.index) > self.memory:
            self._forget()
        new = {p for row in parts for part in row if not isinstance(part, int) for p in part}
        new.difference_update(self.index)
        if new:
            self._learn(sorted(new))
        get = self.index.__getitem__
        for row in parts:
            ids = [np.array([part], np.uint32) if isinstance(part, int) else self._gather(np.fromiter(map(get, part), np.int64, len(part))) for part in row]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def _gather(self, index: np.ndarray) -> np.ndarray:
        start = self.first[index]
        size = self.first[index + 1] - start
        total = int(size.sum())
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.ids[shift + np.arange(total)]


def text_batches(column: pa.Array, max_chars: int = 2 << 20) -> Iterator[list[str | None]]:
    """Consecutive texts of a column in lists of bounded length (a longer text stands alone)."""
    out, size = [], 0
    for value in column:
        text = value.as_py()
        if out and size + len(text or "") > max_chars:
            yield out
            out, size = [], 0
        out.append(text)
        size += len(text or "")
    if out:
        yield out


def _encode_rows(path: str, with_decoded: bool, digests: bool):
    kinds = [("n_tokens", pa.int64()), ("ids", pa.string() if digests else pa.binary())] + [("decoded", pa.string())] * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for texts in text_batches(batch.column("text")):
                for row in encoder.encode(texts):
                    raw = row.astype("<u4").tobytes()
                    counts.append(len(row))
                    ids.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                    if with_decoded:
                        text = encoder.vocab.decode(np.frombuffer(raw, "<u4"))
                        decoded.append(hashlib.sha256(text.encode("utf-8")).hexdigest() if digests else text)
            columns = [batch.column(n) for n in batch.schema.names if n != "text"] + [pa.array(counts, pa.int64()), pa.array(ids, kinds[1][1])]
            columns += [pa.array(decoded, pa.string())] * with_decoded
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "text"] + [k for k, _ in kinds])

    return run


def encode(docs: DataFrame, path: str, decoded: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and, on request, decoded, for each row of ``docs``.

    ``digests`` gives the SHA-256 of ids and decoded instead. A null or empty text has no tokens and decodes to
    an empty text. Every row comes back, rows with null or repeated ids too; other columns are ignored. Special
    strings of the vocabulary are cut out of the text before it is normalised. Texts are whole, of any length.
    """
    schema = f"doc_id long, n_tokens long, ids {'string' if digests else 'binary'}" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_rows(path, decoded, digests), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows with doc_id and ids (binary); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.frombuffer(v.as_py() or b"", "<u4")) for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")
