"""Removal of repeated word windows, by super-k-mer partitioning.

A window is k consecutive words of one text. Its minimiser is the smallest hash
of the short word grams in it, the leftmost if there are several. Consecutive
windows with the same minimiser occurrence form a super-k-mer, which travels as
one packed string (words joined by a space) to the bucket of its minimiser.
Equal windows have equal minimisers, so a bucket sees all copies of its windows;
there they are sorted and counted as whole strings. Two windows of one
super-k-mer are never equal, so a string that is alone in its bucket needs no
look at its windows.

*What travels.* Minimisers are counted first, as bare numbers. A bitmap of fixed
size marks those seen more than once and is broadcast; super-k-mers of others
hold nothing repeated and stay where they are. A bitmap that fills up with the
corpus lets more through and changes no result. In the same way only texts that
hold something repeated are shuffled to meet the spans to remove.

*Hot groups.* Equal strings are merged with a count before the shuffle, so a
group of copies reaches a bucket as a row per some megabytes of text. Which documents
hold a repeated string is found by a second pass and a join that AQE can split.
Grams that are frequent in a sample of documents are ordered last, so that a
common line does not draw windows of different contexts into one bucket. The
sample steers the partitioning only; any order gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm import words
from visitlake.llm.tables import marked
from visitlake.sources.staging import Staging

GRAM_WORDS = 6
# Ordering of frequent grams: sample rate, least count in the sample, most grams.
SAMPLE_RATE, SAMPLE_COUNT, MOST_GRAMS = 32, 16, 1 << 16
# Strings that are merged before they are sent on.
MERGED_BYTES = 12 << 20

_ROW = np.array([0x2545F4914F6CDD1D], np.uint64)
_LAST = np.uint64(1 << 63)


@dataclass
class Runs:
    """Super-k-mers of a chunk: minimiser, first word, windows, and content hash."""

    key: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    content: np.ndarray

    def marked(self, marks: np.ndarray) -> Runs:
        """Those whose minimiser is marked."""
        kept = words.is_marked(self.key, marks)
        return Runs(self.key[kept], self.start[kept], self.windows[kept], self.content[kept])


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each position the index of the leftmost minimum among the next ``width``."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    span = 1

    def wider(at: np.ndarray, shift: int, size: int) -> np.ndarray:
        left, right = at[:size], at[shift : shift + size]
        return np.where(values[right] < values[left], right, left)

    while span * 2 <= width:
        at = wider(at, span, len(values) - 2 * span + 1)
        span *= 2
    if span < width:
        at = wider(at, width - span, n)
    return at[:n]


def row_keys(w: words.Words, h: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A key per row from its id and its words, so rows that share an id differ."""
    weights = words.mix(np.arange(len(h), dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * weights, out=sums[1:])
    text = words.mix(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts.astype(np.uint64))
    numbers = np.array([x if x is not None else -1 for x in ids.to_pylist()], np.int64).view(np.uint64)
    missing = np.array([x is None for x in ids.to_pylist()], np.uint64)
    return words.mix(text ^ words.mix(numbers * _ROW + missing))


def super_kmers(w: words.Words, h: np.ndarray, k: int, frequent: np.ndarray) -> Runs:
    size = min(GRAM_WORDS, k)
    grams, at = w.grams(h, tuple(range(size)))
    last = np.repeat(w.first[1:], w.counts)
    starts = np.flatnonzero(np.arange(len(h)) + k <= last)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none.astype(np.uint64))
    order = np.full(len(h), ~np.uint64(0), np.uint64)
    rank = grams >> np.uint64(1)
    if len(frequent):
        rank[np.isin(grams, frequent)] |= _LAST
    order[at] = rank
    chosen = _leftmost_minimum(order, k - size + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(chosen) != 0) | (np.diff(starts) != 1)
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(starts)))
    start = starts[begin]
    powers, inverse = words._powers_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    content = (sums[start + windows + k - 1] - sums[start]) * inverse[start]
    return Runs(words.mix(order[chosen[begin]]), start, windows, words.mix(content + windows.astype(np.uint64)))


def _packed(w: words.Words, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Words first..last (inclusive) of each run, joined by one space."""
    keep = np.zeros(len(w.data) + 1, bool)
    steps = np.zeros(len(w.data) + 1, np.int8)
    steps[w.starts] += 1
    steps[w.ends] -= 1
    keep[:-1] = np.cumsum(steps[:-1]) > 0
    keep[w.ends] = True  # the byte after a word stands for its separator
    keep = keep[:-1]
    place = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    data = w.data.copy()
    inner = w.ends[w.ends < len(data)]
    data[inner[words.WHITESPACE[data[inner]]]] = 0x20
    text = data[keep].tobytes()
    return [text[a:b] for a, b in zip(place[w.starts[first]], place[w.ends[last]])]


def _frequent_grams(docs: DataFrame, k: int) -> np.ndarray:
    """Grams to be ordered last; at most MOST_GRAMS of them come to the driver."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in words.chunks(batch):
                w = words.words(data, offsets)
                grams, _ = w.grams(w.hashes(), tuple(range(min(GRAM_WORDS, k))))
                yield pa.RecordBatch.from_arrays([pa.array(words.signed(grams))], ["gram"])

    sample = docs.filter(F.crc32(F.col("text").cast("binary")) % SAMPLE_RATE == 0).select("text")
    counts = sample.mapInArrow(run, "gram bigint").groupBy("gram").count()
    top = counts.filter(F.col("count") >= SAMPLE_COUNT).orderBy(F.desc("count"), "gram").limit(MOST_GRAMS)
    return np.sort(np.array([r["gram"] for r in top.collect()], np.int64).view(np.uint64))


def _repeated_marks(docs: DataFrame, k: int, frequent) -> np.ndarray:
    """Bitmap of the minimisers seen more than once."""

    def run(batches):
        for batch in batches:
            keys = []
            for _, data, offsets in words.chunks(batch):
                w = words.words(data, offsets)
                keys.append(super_kmers(w, w.hashes(), k, frequent.value).key)
            key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays([pa.array(words.signed(key)), pa.array(n, pa.int64())], ["key", "n"])

    counted = docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return marked(counted.filter("n > 1"), "key")


def _strings(docs: DataFrame, k: int, frequent, marks) -> DataFrame:
    """Packed super-k-mers; equal ones among some megabytes are one row with a count."""

    def run(batches):
        grams = frequent.value
        for batch in batches:
            seen: dict[bytes, list] = {}
            size = 0
            for _, data, offsets in words.chunks(batch):
                w = words.words(data, offsets)
                runs = super_kmers(w, w.hashes(), k, grams).marked(marks.value)
                texts = _packed(w, runs.start, runs.start + runs.windows + k - 2)
                for key, content, text in zip(
                    words.signed(runs.key).tolist(), words.signed(runs.content).tolist(), texts
                ):
                    if (known := seen.get(text)) is None:
                        seen[text] = [key, content, 1]
                        size += len(text)
                    else:
                        known[2] += 1
                if size > MERGED_BYTES:
                    yield merged(seen)
                    seen, size = {}, 0
            yield merged(seen)

    def merged(seen: dict[bytes, list]) -> pa.RecordBatch:
        rows = list(seen.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array(list(seen), pa.binary()),
            ],
            ["key", "content", "copies", "packed"],
        )

    return docs.select("text").mapInArrow(run, "key bigint, content bigint, copies int, packed binary")


SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _spans(positions: set[int]) -> list[dict]:
    """The positions as [low, high) runs."""
    out: list[dict] = []
    for i in sorted(positions):
        if out and out[-1]["high"] == i:
            out[-1]["high"] = i + 1
        else:
            out.append({"low": i, "high": i + 1})
    return out


def repeated_in_bucket(strings: dict[bytes, int], k: int) -> dict[bytes, list[dict]]:
    """Spans of the windows that occur more than once, per distinct string."""
    cut = []
    for text, copies in strings.items():
        at = [0]
        while (space := text.find(b" ", at[-1])) >= 0:
            at.append(space + 1)
        ends = [x - 1 for x in at[1:]] + [len(text)]
        cut += [(text[at[i] : ends[i + k - 1]], copies, text, i) for i in range(len(at) - k + 1)]
    cut.sort(key=lambda x: x[0])
    flags: dict[bytes, set[int]] = {}
    low = 0
    while low < len(cut):
        high = low + 1
        while high < len(cut) and cut[high][0] == cut[low][0]:
            high += 1
        if high - low > 1 or cut[low][1] > 1:
            for _, _, text, i in cut[low:high]:
                flags.setdefault(text, set()).add(i)
        low = high
    return {text: _spans(at) for text, at in flags.items()}


def _count_windows(k: int):
    def bucket(rows: list[tuple]) -> Iterator[tuple]:
        total: dict[bytes, int] = {}
        content: dict[bytes, int] = {}
        for _, c, n, text in rows:
            total[text] = total.get(text, 0) + n
            content[text] = c
        if len(total) == 1:
            (text, n), = total.items()
            if n > 1:
                yield rows[0][0], content[text], [{"low": 0, "high": text.count(b" ") + 2 - k}]
            return
        for text, spans in repeated_in_bucket(total, k).items():
            yield rows[0][0], content[text], spans

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], SPANS),
            ],
            ["key", "content", "spans"],
        )

    def run(batches):
        held: list[tuple] = []  # rows of the bucket that the last batch ended in
        for b in batches:
            keys = b.column("key").to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            low = np.concatenate([[0], cuts])
            high = np.append(cuts, len(keys))
            copies = b.column("copies").to_numpy()
            # Lone strings hold nothing repeated.
            plain = (high - low == 1) & (copies[low] == 1)
            plain[-1] = False
            plain[0] = plain[0] and not held
            found: list[tuple] = []
            for i in np.flatnonzero(~plain):
                rows = list(zip(*(c.to_pylist() for c in b.slice(low[i], high[i] - low[i]).columns)))
                if held and held[0][0] != rows[0][0]:
                    found += bucket(held)
                    held = []
                held += rows
                if i < len(low) - 1:
                    found += bucket(held)
                    held = []
            yield out(found)
        if held:
            yield out(list(bucket(held)))

    return run


def _places(docs: DataFrame, k: int, frequent, marks) -> DataFrame:
    """Where each super-k-mer lies."""

    def run(batches):
        grams = frequent.value
        for batch in batches:
            for rows, data, offsets in words.chunks(batch):
                w = words.words(data, offsets)
                h = w.hashes()
                runs = super_kmers(w, h, k, grams).marked(marks.value)
                row = np.searchsorted(w.first, runs.start, side="right") - 1
                keys = row_keys(w, h, rows.column(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words.signed(runs.key)),
                        pa.array(words.signed(runs.content)),
                        pa.array(words.signed(keys[row])),
                        pa.array((runs.start - w.first[row]).astype(np.int32)),
                    ],
                    ["key", "content", "row", "start"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, content bigint, row bigint, start int")


def _row_spans(found: DataFrame, k: int) -> DataFrame:
    """Merged [from, to) word spans to remove, per row. A row's list is bounded by its text."""
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            (F.col("start") + s["low"]).alias("low"), (F.col("start") + s["high"] + (k - 1)).alias("high")
        ),
    )
    return found.select("row", F.explode(spans).alias("span")).groupBy("row").agg(
        F.sort_array(F.collect_set("span")).alias("spans")
    )


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _cut_batch(ids: list, texts: list[bytes], spans: list, with_text: bool) -> pa.RecordBatch:
    out = []
    for doc_id, text, gone in zip(ids, texts, spans):
        tokens = text.split()
        kept, done = [], 0
        for span in gone or ():
            kept += tokens[done : max(done, span["low"])]
            done = max(done, span["high"])
        kept += tokens[done:]
        joined = b" ".join(kept)
        digest = hashlib.sha256(joined).hexdigest()
        whole = joined.decode() if with_text else None
        out.append((doc_id, len(tokens), len(tokens) - len(kept), digest, whole))
    columns = list(zip(*out)) or [[]] * 5
    types = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], KEPT_NAMES)


KEPT_NAMES = [field.split()[0] for field in KEPT.split(", ")]


def _by_marks(batch: pa.RecordBatch, marks: np.ndarray, marked: bool):
    """Of each chunk of rows those whose key is, or is not, marked: ids, texts, keys."""
    for rows, data, offsets in words.chunks(batch):
        w = words.words(data, offsets)
        keys = row_keys(w, w.hashes(), rows.column("doc_id"))
        at = np.flatnonzero(words.is_marked(keys, marks) == marked)
        whole = data.tobytes()
        ids = rows.column("doc_id").cast(pa.int64()).take(pa.array(at))
        yield ids, [whole[offsets[i] : offsets[i + 1]] for i in at], keys[at]


def _untouched(docs: DataFrame, marks, with_text: bool) -> DataFrame:
    """Results of the rows that hold nothing repeated."""

    def run(batches):
        for batch in batches:
            for ids, texts, _ in _by_marks(batch, marks.value, False):
                yield _cut_batch(ids.to_pylist(), texts, [None] * len(texts), with_text)

    return docs.mapInArrow(run, KEPT)


def _touched(docs: DataFrame, marks, spans: DataFrame, with_text: bool) -> DataFrame:
    """Results of the other rows, which meet their spans by shuffle."""

    def keyed(batches):
        for batch in batches:
            for ids, texts, keys in _by_marks(batch, marks.value, True):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(texts, pa.binary()), pa.array(words.signed(keys))], ["doc_id", "text", "row"]
                )

    def run(batches):
        for batch in batches:
            yield _cut_batch(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), with_text)

    rows = docs.mapInArrow(keyed, "doc_id bigint, text binary, row bigint")
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, staging: Staging, *, k: int = 50, with_text: bool = True) -> DataFrame:
    """Each text without the words of windows that occur more than once.

    ``docs`` has a whole-number doc_id and text; other columns are ignored.
    Returns a row per row: doc_id, n_words, n_removed, kept_sha256 and kept (the
    remaining words joined by one space; null unless ``with_text``). A null or
    empty text has no words. Rows that share a doc_id, also a null one, are
    judged by their own texts; a row given twice is a repeat of itself. Windows
    are judged on the input. The result reads tables in ``staging``.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent_grams(docs, k))
    marks = spark.sparkContext.broadcast(_repeated_marks(docs, k, frequent))
    strings = _strings(docs, k, frequent, marks).repartition("key").sortWithinPartitions("key")
    repeated = staging.write(
        strings.select("key", "content", "copies", "packed").mapInArrow(
            _count_windows(k), "key bigint, content bigint, spans array<struct<low:int,high:int>>"
        ),
        "repeated",
    )
    found = _places(docs, k, frequent, marks).join(repeated, ["key", "content"])
    spans = staging.write(_row_spans(found, k), "spans")
    touched = spark.sparkContext.broadcast(marked(spans, "row"))
    return _untouched(docs, touched, with_text).unionByName(_touched(docs, touched, spans, with_text))
