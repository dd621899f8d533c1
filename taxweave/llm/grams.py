"""Words and runs of words of Arrow text columns as 64-bit hashes, whole columns at a time.

Hashes are polynomials modulo 2^64, taken as differences of running sums, so that a window of
any width costs the same; a final mix spreads them. Two different words or windows meet with a
chance of about 2^-64 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once, and the length of the kept tables of powers.
SEGMENT = 1 << 18
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _table(separators: bytes, lower: bool) -> np.ndarray:
    """For each byte its value in a word, 0 for a separator."""
    table = np.arange(1, 257, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Also cut at ASCII marks, for texts that are compared whatever their punctuation.
MARKS = BLANKS + bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
PLAIN, LOWERED, BARE = _table(BLANKS, False), _table(BLANKS, True), _table(MARKS, True)


class Words(NamedTuple):
    doc: np.ndarray  # row of the column
    start: np.ndarray  # bytes in the column's buffer
    end: np.ndarray
    hash: np.ndarray


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, or of the inverse of the odd base."""
    kept = _powers.get((int(base), inverse))
    if kept is None or len(kept) < n:
        step = pow(int(base), -1, 1 << 64) if inverse else int(base)
        kept = np.ones(max(n, SEGMENT + 1), np.uint64)
        kept[1:] = np.uint64(step)
        kept = _powers[int(base), inverse] = np.cumprod(kept, dtype=np.uint64)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row begins in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return data[first:last], offsets - first if len(column) else np.zeros(1, np.int64)


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> Words:
    """The words of each row in order."""
    found, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n:  # don't cut a word
            gaps = np.flatnonzero(table[data[max(at, stop - 4096) : stop]] == 0)
            if len(gaps):
                stop = max(at, stop - 4096) + int(gaps[-1]) + 1
                break
            row_start = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if row_start > at:
                stop = row_start
                break
            stop = min(n, stop + SEGMENT)
        found.append(_segment(data, at, stop, offsets, table))
        at = stop
    if not found:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    start, end, hashes = (np.concatenate(x) for x in zip(*found))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, hashes)


def _segment(data, at, stop, offsets, table):
    values = table[data[at:stop]]
    inside = np.zeros(len(values) + 2, bool)
    inside[1:-1] = values != 0
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop)] - at  # rows that begin inside
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    hashes = (sums[end] - sums[start]) * powers(BASE, len(values), True)[start]
    return start + at, end + at, mix(hashes + (end - start).astype(np.uint64))


def windows(doc: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of `width` words that lie in one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=sums[1:])
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    values = (sums[whole + width] - sums[whole]) * powers(WORD_BASE, n, True)[whole]
    return whole, mix(values)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
