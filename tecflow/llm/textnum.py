"""Words of many texts at once in NumPy, straight from Arrow's UTF-8 buffers.

Words are maximal runs of bytes other than space and \\t to \\r. Every word gets
a 64-bit hash of its bytes, so counting, windows and look-ups are array work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; kept for later calls as far as a piece of texts needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        have = np.full(size, np.uint64(base % (1 << 64)), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size == PIECE_BYTES + 1:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """Some rows of a batch: first row, their UTF-8 bytes, where each text starts (one more entry than rows)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of Texts in order: start and end byte, row, hash; first: index of each row's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def per_row(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sum of values (1 each if none are given) by row."""
        if values is None:
            return np.diff(self.first)
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.first[1:]] - total[self.first[:-1]]


def pieces(column: pa.Array, limit: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[Texts]:
    """A string column as Texts of at most limit bytes and rows, or one row each; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, start = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + start)[start:] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield Texts(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(OF_BYTE[data] * powers(BASE, n), out=total[1:])
    return mixed((total[end] - total[start]) * powers(BASE_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def words(texts: Texts, lower: bool = False, apart: np.ndarray = SPACE) -> Words:
    """apart: for each byte, whether it separates words."""
    data = LOWER[texts.data] if lower else texts.data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    borders = np.zeros(len(data) + 1, bool)
    borders[texts.offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | borders))
    end = np.flatnonzero(before & (~here | borders))
    first = np.searchsorted(start, texts.offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, row, hashes(data, start, end), first)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of size words that lies in one row."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(found.row[:n] == found.row[size - 1 :])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total + found.hash[k : k + n])
    return whole, total[whole]


def char_starts(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every UTF-8 character."""
    return (data & 0xC0) != 0x80


def row_of_bytes(texts: Texts) -> np.ndarray:
    return np.repeat(np.arange(len(texts)), np.diff(texts.offsets))


def count_rows(texts: Texts, where: np.ndarray) -> np.ndarray:
    """True entries of a byte-wise mask, by row."""
    total = np.concatenate(([0], np.cumsum(where)))
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]
