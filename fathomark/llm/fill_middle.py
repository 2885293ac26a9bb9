"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix at two unit boundaries.

A unit is a word with the white space before it; white space after the last word is a unit of its own. A text is
laid out in fixed blocks of ``BLOCK`` bytes. For each block the units that end in it and the code points that begin
in it are counted; one Fenwick tree over all blocks of a chunk of texts holds both counts. A cut after ``k`` units
is found by a binary-lifting descent to the block in which the k-th unit of its text ends; only that block is then
searched for the boundary, and the tree's prefix sums give the code points before it. All cuts of a chunk descend
together, so the Python work is a few numpy calls a chunk.

Where to cut, and the form, come from the document's id alone, so the result does not depend on the layout of the
table and a lost task repeats it exactly. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomark.llm.words import ASCII_WHITE, chunks

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class FenwickTree:
    """Prefix sums of non-negative counts (one row per kind), with descents for many targets at once."""

    def __init__(self, counts: np.ndarray) -> None:
        self.size = counts.shape[1]
        self.sums = np.zeros((len(counts), self.size + 1), np.int64)
        self.sums[:, 1:] = counts
        step = 1
        while 2 * step <= self.size:
            at = np.arange(2 * step, self.size + 1, 2 * step)
            self.sums[:, at] += self.sums[:, at - step]
            step *= 2

    def before(self, block: np.ndarray, kind: int) -> np.ndarray:
        """The sum of the counts of the blocks in front of each given block."""
        at, total = np.array(block, np.int64), np.zeros(len(block), np.int64)
        while at.any():
            total += self.sums[kind, at]
            at &= at - 1
        return total

    def descend(self, target: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """For each target >= 1: the block in which the running sum first reaches it, and what is left to count there."""
        at, left = np.zeros(len(target), np.int64), np.array(target, np.int64)
        step = 1 << max(self.size.bit_length() - 1, 0)
        while step:
            to = at + step
            inside = to <= self.size
            part = self.sums[kind, np.minimum(to, self.size)]
            go = inside & (part < left)
            at = np.where(go, to, at)
            left = np.where(go, left - part, left)
            step >>= 1
        return at, left


class Blocks:
    """Block counts of the texts of one chunk, and their tree; kind 0: unit ends, kind 1: code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.offsets, self.block = data, offsets, block
        length = np.diff(offsets)
        self.each = -(-length // block)
        self.first = np.concatenate([[0], np.cumsum(self.each)])
        text = np.repeat(np.arange(len(length)), self.each)
        self.start = offsets[text] + (np.arange(len(text)) - self.first[text]) * block
        self.stop = np.minimum(self.start + block, offsets[text + 1])
        white = ASCII_WHITE[data]
        last = np.zeros(len(data), bool)
        last[offsets[1:][length > 0] - 1] = True
        # A unit ends where a word does, or where the text does.
        self.ends = last.copy()
        self.ends[:-1] |= ~white[:-1] & white[1:]
        points = (data & 0xC0) != 0x80
        if len(self.start):
            self.tree = FenwickTree(np.stack([np.add.reduceat(x.astype(np.int64), self.start) for x in (self.ends, points)]))
        else:
            self.tree = FenwickTree(np.zeros((2, 0), np.int64))

    def units(self) -> np.ndarray:
        """The number of units of each text."""
        return self.tree.before(self.first[1:], 0) - self.tree.before(self.first[:-1], 0)

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte position, code points before it in its text) of the boundary after so many units of each given text."""
        place, points = self.offsets[text].copy(), np.zeros(len(text), np.int64)
        some = np.flatnonzero(units > 0)
        if len(some):
            first = self.first[text[some]]
            block, left = self.tree.descend(self.tree.before(first, 0) + units[some], 0)
            # Only the blocks of the cuts are searched; a bounded number of them at a time.
            local = np.zeros(len(some), np.int64)
            inside = np.zeros(len(some), np.int64)
            for k in range(0, len(some), 4096):
                rows = slice(k, k + 4096)
                at = self.start[block[rows], None] + np.arange(self.block)
                there = at < self.stop[block[rows], None]
                at = np.minimum(at, len(self.data) - 1)
                local[rows] = (np.cumsum(self.ends[at] & there, 1) < left[rows, None]).sum(1) + 1
                upto = np.arange(self.block) < local[rows, None]
                inside[rows] = (((self.data[at] & 0xC0) != 0x80) & there & upto).sum(1)
            place[some] = self.start[block] + local
            points[some] = self.tree.before(block, 1) - self.tree.before(first, 1) + inside
        return place, points


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(seed: int, doc_id: int) -> tuple[int, int, int, int]:
    """Four 32-bit draws of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _rows(seed: int, fim_percent: int, spm_percent: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                blocks = Blocks(data, offsets, block)
                n = blocks.units()
                raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                drawn = [draws(seed, i) if i is not None else None for i in ids[lo:hi]]
                moved = np.array([k for k, (t, h) in enumerate(zip(raw, drawn)) if t and h and h[2] % 100 < fim_percent and not any(m in t for m in (PREFIX, SUFFIX, MIDDLE))], np.int64)
                ends = np.array([sorted(h % (int(n[k]) + 1) for h in drawn[k][:2]) for k in moved.tolist()], np.int64).reshape(-1, 2)
                place, points = blocks.cut(np.repeat(moved, 2), ends.ravel())
                form, output = ["plain"] * len(raw), list(raw)
                head, body = [None] * len(raw), [None] * len(raw)
                for k, (a, b), (x, y) in zip(moved.tolist(), place.reshape(-1, 2).tolist(), points.reshape(-1, 2).tolist()):
                    base = int(offsets[k])
                    before, middle, after = raw[k][: a - base], raw[k][a - base : b - base], raw[k][b - base :]
                    form[k] = "spm" if drawn[k][3] % 100 < spm_percent else "psm"
                    output[k] = b"".join((SUFFIX, after, PREFIX, before, MIDDLE, middle) if form[k] == "spm" else (PREFIX, before, SUFFIX, after, MIDDLE, middle))
                    head[k], body[k] = x, y - x
                text = pa.array(output, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(n), pa.array(form), pa.array(head, pa.int64()), pa.array(body, pa.int64()), text], schema=OUT)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Form is ``plain`` (the text as it is; the two counts null), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
    prefix, middle), each part behind its mark. Null and empty texts, and texts that hold a mark, stay plain; a null
    text is empty. Rows with a null id have no draw and stay plain. Rows that share an id draw alike, each on its own
    text. Texts of any length are taken whole; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rows(seed, fim_percent, spm_percent, block), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text of an output: its three parts put back in order. No part holds a mark, so the marks split it exactly."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<P>|<S>|<M>")
    text = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.coalesce(text, output)
