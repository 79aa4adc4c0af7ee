"""Which files may hold a keyword: bitmaps of the byte trigrams of urls and titles.

Each entry covers the rows that one task has read of one file. A keyword's literal parts
can only match where all their trigrams occur, so files none of whose entries has them
are not read; the keyword itself is then searched as ever. Letters A to Z are folded, so
one index serves both kinds of search. What has no literal part of three bytes, and files
without an entry, are read in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of an entry: 16 kB. Urls and titles of a large file have some ten thousand trigrams.
BITS = 1 << 17
_WORDS = BITS // 64
ENTRIES = "visit_day date, file string, bits array<bigint>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _bits_of(data: np.ndarray) -> np.ndarray:
    """Bit numbers of the trigrams that start at each byte but the last two."""
    low = _FOLD[data].astype(np.uint64)
    code = low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64)


def _column_bits(column: pa.Array, seen: np.ndarray) -> None:
    """Marks the trigrams of a string column; none goes across two values."""
    column = column.cast(pa.large_string()).drop_null()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    if len(data) < 3:
        return
    inside = np.ones(len(data), bool)
    ends = offsets[1:] - offsets[0]
    for back in (1, 2):
        inside[ends[ends >= back] - back] = False
    seen[_bits_of(data)[inside[:-2]]] = True


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """visit_day, file, url, title to an entry per file of this task."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        days, files = batch.column(0), batch.column(1).dictionary_encode()
        for code, file in enumerate(files.dictionary.to_pylist()):
            rows = np.flatnonzero(files.indices.to_numpy() == code)
            seen = held.setdefault((days[int(rows[0])].as_py(), file), np.zeros(BITS, bool))
            part = batch.take(pa.array(rows))
            for column in (part.column(2), part.column(3)):
                _column_bits(column, seen)
    for (day, file), seen in held.items():
        words = np.packbits(seen, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"visit_day": pa.array([day], pa.date32()), "file": [file], "bits": pa.array([words], pa.list_(pa.int64()))}
        )


def keyword_bits(keyword: str) -> list[int]:
    """Bits that a row matching a LIKE keyword sets; empty if that is unknown."""
    found: set[int] = set()
    for literal in re.split("[%_]", keyword):
        raw = np.frombuffer(literal.encode(), np.uint8)
        if len(raw) >= 3:
            found.update(_bits_of(raw).tolist())
    return sorted(found)


def may_hold(bits: list[int], words: Column) -> Column:
    """Whether an entry has all bits."""
    masks: dict[int, int] = {}
    for bit in bits:
        masks[bit // 64] = masks.get(bit // 64, 0) | 1 << (bit % 64)
    test = F.lit(True)
    for word, mask in masks.items():
        signed = mask - (1 << 64) if mask >> 63 else mask
        test &= F.get(words, F.lit(word)).bitwiseAND(F.lit(signed).cast("bigint")) == signed
    return test


def skippable(index: DataFrame, bits: list[int]) -> DataFrame:
    """Files of the index that no entry lets hold the keyword."""
    return index.groupBy("file").agg(F.max(may_hold(bits, F.col("bits"))).alias("may")).filter("NOT may").select("file")
