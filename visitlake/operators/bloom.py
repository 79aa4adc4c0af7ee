"""Bloom filters as tables: built by an aggregate, applied by a broadcast semi-join.

Spark builds such filters for its own joins only where it expects a small side. Here a
batch of any size cuts the store before the store is shuffled. Each key sets ``BITS_SET``
bits of one 64-bit word, and words lie in segments, one row each, so a filter takes
``BITS`` per key in memory and a test reads one word. What passes is a superset of the
keys; an exact join has to follow.

A filter covers a range of times. A large batch gets several, cut at quantiles of its
times, and each range of the store meets its own filter in a job of its own, so that no
executor ever holds more than one. Filters have a fixed most size: where many keys share
an instant more rows pass, and the result stays the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.sources.staging import Staging

BITS = 16  # per key; about 0.5 % of other rows pass
BITS_SET = 4
SEGMENT_WORDS = 64
KEYS_A_SEGMENT = SEGMENT_WORDS * 64 // BITS
# Keys of one filter: 64 MB.
MOST_KEYS = 1 << 25
_QUANTILE_ACCURACY = 10_000


def _segments(n_keys: int) -> int:
    # Odd, as the words within a segment go by the low bits of the same hash.
    return -(-min(max(n_keys, 1), MOST_KEYS) // KEYS_A_SEGMENT) | 1


def _segment(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 58).cast("int")


def _mask(key: Column) -> Column:
    """``BITS_SET`` bits of a word, by as many fields of the hash."""
    mask = F.lit(0).cast("bigint")
    for k in range(BITS_SET):
        at = F.shiftrightunsigned(key, 16 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def build(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """segment, words of a filter of hashed keys, which may repeat."""
    hashed = F.col(key)
    bits = keys.groupBy(_segment(hashed, _segments(n_keys)).alias("segment"), _word(hashed).alias("word")).agg(
        F.bit_or(_mask(hashed)).alias("bits")
    )
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most SEGMENT_WORDS
    rows = bits.groupBy("segment").agg(held.alias("held"))
    places = F.sequence(F.lit(0), F.lit(SEGMENT_WORDS - 1))
    words = F.transform(places, lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("bigint")))
    return rows.select("segment", words.alias("words"))


def passing(rows: DataFrame, key: str, filter_rows: DataFrame, n_keys: int) -> DataFrame:
    """Rows whose hashed key may be among those of the filter."""
    mask = _mask(F.col(key))
    found = F.get(F.col("words"), _word(F.col(key))).bitwiseAND(mask) == mask
    at = _segment(F.col(key), _segments(n_keys)) == F.col("segment")
    return rows.join(F.broadcast(filter_rows), at & found, "left_semi")


@dataclass(frozen=True)
class _Slice:
    """Times from ``low`` up to, not with, ``high``; None is no bound."""

    low: int | None
    high: int | None

    def of(self, frame: DataFrame, time: str) -> DataFrame:
        if self.low is not None:
            frame = frame.filter(F.col(time) >= self.low)
        return frame if self.high is None else frame.filter(F.col(time) < self.high)


def time_slices(batch: DataFrame, time: str, n_rows: int) -> list[_Slice]:
    """Ranges of time with about ``MOST_KEYS`` rows of the batch each."""
    n = -(-n_rows // MOST_KEYS)
    if n <= 1:
        return [_Slice(None, None)]
    shares = [i / n for i in range(1, n)]
    found = batch.agg(F.percentile_approx(time, shares, _QUANTILE_ACCURACY).alias("bounds")).first()["bounds"]
    bounds = [None, *sorted(set(found or ())), None]
    return [_Slice(low, high) for low, high in zip(bounds, bounds[1:])]


def cut(stored: DataFrame, batch: DataFrame, on: list[str], time: str, n_rows: int, staging: Staging | None) -> DataFrame:
    """Rows of ``stored`` that may have a key of the batch, which has at most ``n_rows`` rows.

    With more than one filter the rows that pass are staged range by range; without
    ``staging`` such a batch cuts nothing.
    """
    slices = time_slices(batch, time, n_rows)
    if len(slices) > 1 and staging is None:
        return stored
    out = None
    for i, part in enumerate(slices):
        keys = part.of(batch, time).select(F.xxhash64(*on).alias("key_hash"))
        rows = part.of(stored, time).withColumn("key_hash", F.xxhash64(*on))
        n_keys = min(n_rows, MOST_KEYS)
        kept = passing(rows, "key_hash", build(keys, "key_hash", n_keys), n_keys).drop("key_hash")
        if len(slices) > 1:
            kept = staging.write(kept, f"known-{i}")
        out = kept if out is None else out.unionByName(kept)
    return out
