"""Words of many texts at once, as numpy arrays over an Arrow column's bytes: no Python object for a word.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash is a polynomial over a table of random 64-bit numbers, one for each
byte, taken from running sums, then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together at most (a single longer text is a part of its own).
PART_BYTES = 2 << 20
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... as n unsigned 64-bit numbers."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


_held: dict[int, np.ndarray] = {}


def powers_of(base: int, n: int) -> np.ndarray:
    if base not in _held or len(_held[base]) < n:
        _held[base] = _powers(base, n)
    return _held[base][:n]


@dataclass
class Words:
    """first: index of each text's first word, and the number of all words at the end. start and end are places in data."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """data: bytes of texts one after another; offsets: where each begins, and the end."""
    n = len(data)
    inside = ~_SPACES[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _EXACT)[data] * powers_of(BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * powers_of(INVERSE, n)[start] + (end - start).astype(np.uint64))
    return Words(data, np.searchsorted(start, offsets), start, end, hashes)


def parts(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their Words) for successive rows of a column of strings; nulls have no words."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART_BYTES, "right")) - 1)
        own = offsets[row : to + 1]
        yield row, to, words_of(data[own[0] : own[-1]], own - own[0], lower)
        row = to
