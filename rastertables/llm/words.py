"""Words, word hashes and rolling windows of Arrow text columns, in numpy.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; a null text has no words. Work goes over slices of whole rows, so memory follows the
slice (or one long row), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_WORD_BASE = 0xD1342543DE82EF95
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Places in a word whose byte values are kept.
_PLACES = 64


def _byte_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((place << 8 | data).astype(np.uint64))


_BYTE_VALUE = _byte_values(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256))


#: Powers of each base so far, kept up to this many.
_KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if len(known) <= _KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `size` bytes; a longer row is a range by itself."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, rows)
        low = high


@dataclass
class Words:
    """Words of some rows: byte spans, and where each row's words begin (rows + 1 values)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with ASCII letters folded if `lower`.

        Every pair of a byte and its place in the word has a value of its own; no algebra ties them.
        """
        if not len(self):
            return np.zeros(0, np.uint64)
        first = int(self.starts[0])
        data = (_LOWER[self.data[first:]] if lower else self.data[first:]).astype(np.int64)
        starts, ends = self.starts - first, self.ends - first
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        values = _BYTE_VALUE[np.minimum(place, _PLACES - 1) << 8 | data]
        late = np.flatnonzero(place >= _PLACES)
        values[late] = _byte_values(data[late], place[late])
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `size` consecutive words of one row."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fits = np.zeros(n + 1, np.int32)
        long = np.diff(self.rows) >= size
        np.add.at(fits, self.rows[:-1][long], 1)
        np.add.at(fits, self.rows[1:][long] - size + 1, -1)
        first = np.flatnonzero(np.cumsum(fits[:-1]))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_WORD_BASE, n), out=total[1:])
        inverse = powers(pow(_WORD_BASE, -1, 1 << 64), n + 1)
        return first, mix((total[first + size] - total[first]) * inverse[first])


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows given by their bytes and offsets, the first of which is 0."""
    inside = ~_SEPARATOR[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[filled], offsets[filled + 1] - 1
    begins[heads], stops[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def word_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for each slice of a text column."""
    data, offsets = text_buffer(column)
    for low, high in row_slices(offsets):
        base = offsets[low]
        yield low, high, split_words(data[base:offsets[high]], offsets[low:high + 1] - base)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
