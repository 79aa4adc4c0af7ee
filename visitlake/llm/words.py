"""Words of whole texts as numpy arrays, for code that runs inside Arrow batches.

Texts are taken as UTF-8 bytes. Only ASCII bytes separate words or change case,
so nothing needs decoding. A null text counts as an empty one. Batches are cut
into chunks of a megabyte, which bounds memory; a text longer than that is
a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
WHITESPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_ALNUM = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
)
# Everything in ASCII but letters and digits separates.
NON_ALNUM = (_BYTES < 128) & ~_ALNUM

_LOWER = _BYTES.astype(np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the murmur3 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_VALUES_LOWER = _BYTE_VALUES[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a chunk of rows. ``first`` has one entry more than there are rows:
    row r owns the words first[r]:first[r + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lower: bool

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        n = len(self.data)
        powers, inverse = _powers_to(n + 1)
        values = (_BYTE_VALUES_LOWER if self.lower else _BYTE_VALUES)[self.data]
        values *= powers[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def grams(self, h: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of word tuples at the given offsets, and the index of their first word.

        Tuples that would reach beyond their row are left out.
        """
        span = offsets[-1]
        n = len(h) - span
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for k, offset in enumerate(offsets):
            weight = np.uint64(pow(_BASE, k + 1, 1 << 64))
            total += h[offset : offset + n] * weight
        row_end = np.repeat(self.first[1:], self.counts)[:n]
        inside = np.arange(n) + span < row_end
        start = np.flatnonzero(inside)
        return mix(total[start] + np.uint64(len(offsets) * 0x51ED27)), start


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and row offsets of their texts."""
    if batch.num_rows == 0:
        return
    data, offsets = _buffers(batch.column(batch.schema.get_field_index(text)))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        part = data[offsets[low] : offsets[high]]
        yield batch.slice(low, high - low), part, offsets[low : high + 1] - offsets[low]
        low = high


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE, lower: bool = False
) -> Words:
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first, lower)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return h.view(np.int64)


def is_marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether a bitmap of ``tables.marked`` has the keys; it may have others, too."""
    at = keys & np.uint64(64 * len(marks) - 1)
    return (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
