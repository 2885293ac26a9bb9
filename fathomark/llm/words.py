"""Words of many texts at once: flat numpy arrays of 64-bit word hashes, window hashes, bounded chunks.

A text is its UTF-8 bytes; words are maximal runs of bytes other than the separators. One chunk holds at
most ``CHUNK_BYTES`` of text (or one single longer text), so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_U = np.uint64

ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20
TO_LOWER.flags.writeable = False
_IDENTITY = np.arange(256, dtype=np.uint8)


@dataclass
class Flat:
    """Words of consecutive texts: hash, byte range in ``data``, and where each text's words begin."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # length texts + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def join(self, words: np.ndarray, sep: bytes = b" ") -> bytes:
        """The given words of one text, joined."""
        raw, s, e = self.data, self.start, self.end
        return sep.join(raw[a:b].tobytes() for a, b in zip(s[words].tolist(), e[words].tolist()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = ASCII_WHITE, lower: bool = False) -> Flat:
    data = TO_LOWER[data] if lower else data
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = before[n] = True
    before[1:n] = ~inside[:-1]
    before |= edge
    start = np.flatnonzero(inside & before[:n])
    after = np.ones(n, bool)
    if n:
        after[:-1] = ~inside[1:]
    after |= edge[1:]
    end = np.flatnonzero(inside & after) + 1
    return Flat(data, hash_slices(data, start, end), start, end, np.searchsorted(start, offsets))


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice, eight bytes a step over all slices at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
    left = end - start
    out = mix(left.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    at, live = start.copy(), np.arange(len(start))
    while len(live):
        part = np.ascontiguousarray(eight[at[live]]).view(np.uint64)[:, 0]
        short = np.minimum(left[live], 8)
        part = part & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - short.astype(np.uint64) * _U(8)))
        out[live] = mix(out[live] * _U(0x9E3779B97F4A7C15) + part)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values; the caller masks runs that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` words that starts at a word stays inside its text."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    for k in range(1, size):
        edge = first[1:] - k
        ok[edge[edge >= first[:-1]]] = False
    # Texts shorter than the window: every word of theirs is within `size - 1` of the end, so all are off.
    return ok
