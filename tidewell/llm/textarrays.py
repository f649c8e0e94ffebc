"""Whole texts of an Arrow column as flat NumPy arrays: bytes, words, shingles.

Everything works on slices of about ``SLICE_BYTES`` of text (a longer text is a slice of its own), so memory is bounded by
the slice and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS = _powers(4096)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` (or runs of bytes that are not ``outside``) of a slice: ``start``, ``end``, ``code`` (64-bit), and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, outside: np.ndarray = IS_SPACE):
        rows = len(offsets) - 1
        inside = ~outside[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        ends = offsets[1:] - 1
        ends = ends[ends >= 0]
        closes[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.rows = rows
        if not len(self.start):
            self.code = np.zeros(0, dtype=np.uint64)
            return
        place = np.arange(len(data))
        place -= self.start[np.maximum(np.cumsum(opens) - 1, 0)]
        longest = int((self.end - self.start).max())
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        terms = _BYTE_CODE[LOWER[data] if lower else data]
        terms *= powers[np.where(inside, place, 0)]
        terms[~inside] = 0
        self.code = mix64(np.add.reduceat(terms, self.start))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, first shingle of each row): every run of ``width`` words; a shorter row is one shingle of all its words."""
        counts = np.diff(self.first)
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(self.rows), n)
        at = self.first[:-1][row] + (np.arange(first[-1]) - first[row])
        codes = np.zeros(len(at), dtype=np.uint64)
        padded = np.concatenate([self.code, np.zeros(width, dtype=np.uint64)])
        left = self.first[1:][row] - at
        factor = np.uint64(1)
        for j in range(width):
            factor = np.uint64((int(factor) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64) | 1)
            codes += np.where(j < left, padded[at + j] * factor, np.uint64(j + 1))
        return mix64(codes), first


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle codes of each row) by slices."""
    for lo, _, data, offsets in slices(column):
        codes, first = Words(data, offsets).shingles(width)
        yield lo, [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
