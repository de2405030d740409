"""Whole Arrow batches of texts as flat byte and word arrays, for use inside tasks.

A batch of texts is one byte buffer; words, their hashes and runs of words are found for all
texts of the batch at once with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed odd multipliers and their inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93

BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and their bounds; null reads as empty."""
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(_STEP)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled, factor = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
        filled += more
    return out[:n]


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``first`` word of each text, ``hash``."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        data, self.bounds = byte_buffer(column)
        self.data = _UPPER[data] if lower else data
        inside = ~_SPACE[data]
        first_byte = inside.copy()
        first_byte[1:] &= ~inside[:-1]
        begins = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        first_byte[begins] |= inside[begins]
        last_byte = inside.copy()
        last_byte[:-1] &= ~inside[1:]
        last_byte[begins[begins > 0] - 1] |= inside[begins[begins > 0] - 1]
        self.start, self.end = np.flatnonzero(first_byte), np.flatnonzero(last_byte) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        """Polynomial in the bytes from the word's start on, times its length's code."""
        weighted = BYTES[self.data] * powers(BASE, len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(weighted, out=total[1:])
        sums = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, len(self.data) + 1)[self.start]
        return mixed(sums + (self.end - self.start).astype(np.uint64))

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those within one text mean anything."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = self.hash[:n].copy()
        for j in range(1, k):
            total *= np.uint64(BASE)
            total += self.hash[j : j + n]
        return mixed(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 21):
    """Rows of a batch in slices of bounded text, so that the flat arrays stay small.

    A single text beyond the bound is a slice of its own.
    """
    column = batch.column(text).fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
