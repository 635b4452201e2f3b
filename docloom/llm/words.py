"""Vectorised word and window hashing over Arrow string columns.

A batch's texts lie one after another in a byte buffer. All work is numpy on
slices of about half a megabyte of that buffer, so a Python worker's memory follows
the slice (or one longer text), not the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 60)) * 8 + 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_rng.integers(1 << 40, 1 << 60)) * 8 + 5)


def _class_table(is_word) -> np.ndarray:
    """Byte value to lower-cased byte; 0 where the byte separates words."""
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    return np.array([low(b) if is_word(low(b)) else 0 for b in range(256)], np.uint8)


#: Words are runs without the ASCII blanks.
BLANK_SEPARATED = _class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
BLANK_SEPARATED[0] = 1  # NUL belongs to a word; 1 keeps it apart from "separator"
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALPHANUMERIC = _class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd multipliers); works on a copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base % (1 << 64), np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of some consecutive texts; positions are bytes of ``data``."""

    data: np.ndarray  # uint8, the texts' bytes
    bounds: np.ndarray  # int64, text k is data[bounds[k]:bounds[k+1]]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # int64, words of text k are first[k]:first[k+1]
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` consecutive words of one text, and the index of each first word."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h *= _STEP
            h += self.hash[k : n - width + 1 + k]
        owner = self.owners()
        at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        return mix(h[at]), at


def split_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    bounds = bounds - bounds[0]
    n = len(data)
    mapped = table[data]
    inside = np.zeros(n + 1, np.bool_)
    inside[:n] = mapped != 0
    cut = np.zeros(n + 1, np.bool_)
    cut[bounds] = True
    before = np.zeros(n + 1, np.bool_)
    before[1:] = inside[:n]
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[mapped] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), mix(h))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``."""
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1]
        row = stop


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start index of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
