"""Benchmark passages in training texts: counted word pairs, then Smith-Waterman.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower
case. All pairs of neighbouring words of each test item are looked up in the texts,
with at most one word between them there. An alignment that reaches the least score
holds a number of such pairs within a stretch of bounded length (``Block.need``), so
an item is aligned just where a text has that many: nothing over the least score is
left out, whatever is common or leaked elsewhere. Item and passage are aligned word
by word, which scores edited and paraphrased copies. A second alignment, in which
edits cost more, finds long passages that are a small part of their item.

Items are taken in blocks of bounded size. A block is broadcast and each text is
scanned where it lies, so no text and no word of one is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitlake.llm import words

SHORT = 3  # items of at most so many words are found as a whole
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SIMILARITY = 0.5  # alignment score over that of a full match
# A passage counts whatever its share of the item if so many more of its words match
# than are edited. There an edit costs what a match gains, so most of it matches.
LONG_WORDS, EDIT = 13, -2
BLOCK_WORDS = 400_000  # words of benchmark items per broadcast
_SLOTS = 1 << 22
_HITS_AT_ONCE = 1 << 22


def align(item: np.ndarray, passage: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """Best local alignment score and the end of the passage's part of it."""
    steps = np.arange(len(passage) + 1) * -gap
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        fresh = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, mismatch), row[1:] + gap, out=fresh[1:])
        np.maximum(fresh, 0, out=fresh)
        # A gap in the item costs the same at each step, so a running maximum settles it.
        row = np.maximum.accumulate(fresh + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


@dataclass
class Block:
    """Items of one broadcast: their word hashes and the place of each gram, a pair
    of neighbouring words or the whole of a short item."""

    ids: list[int | None]
    hashes: list[np.ndarray]
    grams: np.ndarray  # sorted
    owner: np.ndarray

    def filter_table(self) -> np.ndarray:
        table = np.zeros(_SLOTS, bool)
        table[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        return table

    def sizes(self) -> np.ndarray:
        return np.array([len(h) for h in self.hashes])

    def need(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that an alignment of each item has at least, and the words it spans at most.

        Between two matches that are no such pair lies a word of the item, which
        costs 1, or two words of the text, which cost 2. With m matches, g pairs and
        a of the former, m + a words fit in n and the score is at most 2 + 2 g + a.
        In a long passage m exceeds the edits, a at least, by LONG_WORDS.
        """
        n = self.sizes()
        score = MATCH * least * n
        pairs = np.maximum(np.ceil((2 * score - n - 3) / 3 - 1e-9), 1).astype(np.int64)
        pairs = np.where(n >= LONG_WORDS, np.minimum(pairs, LONG_WORDS - 1), pairs)
        return np.where(n > SHORT, pairs, 1), np.ceil(np.maximum(3 * n - score, 2 * n)).astype(np.int64)


def _grams(w: words.Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return w.grams(h, tuple(range(size)))


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items, in blocks of bounded size. Items without words are left out."""
    ids: list[int | None] = []
    hashes: list[np.ndarray] = []

    def closed() -> Block:
        grams, owner = [], []
        for i, h in enumerate(hashes):
            size = len(h) if len(h) <= SHORT else 2
            alone = words.Words(np.zeros(0, np.uint8), h, h, np.array([0, len(h)]), True)
            own = np.unique(_grams(alone, h, size)[0])
            grams.append(own)
            owner.append(np.full(len(own), i))
        joined, who = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(joined, kind="stable")
        return Block(ids, hashes, joined[order], who[order])

    held = 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = np.frombuffer((row["text"] or "").encode(), np.uint8)
        w = words.words(text, np.array([0, len(text)]), words.NON_ALNUM, lower=True)
        if not len(w.starts):
            continue
        if ids and held + len(w.starts) > BLOCK_WORDS:
            yield closed()
            ids, hashes, held = [], [], 0
        ids.append(row["item_id"])
        hashes.append(w.hashes())
        held += len(w.starts)
    if ids:
        yield closed()


def _hits(block: Block, table: np.ndarray, w: words.Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word positions of a chunk at which a gram of the block begins, the range of
    its places there, and whether a word lies between."""
    sizes = set(block.sizes().tolist())
    lookups = [tuple(range(size)) for size in range(1, SHORT + 1) if size in sizes or size == 2]
    parts = []
    for offsets in [*lookups, (0, 2)]:
        grams, start = w.grams(h, offsets)
        maybe = np.flatnonzero(table[(grams >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(block.grams, grams[maybe], side="left")
        high = np.searchsorted(block.grams, grams[maybe], side="right")
        sure = np.flatnonzero(high > low)
        parts.append((start[maybe[sure]], low[sure], high[sure], np.full(len(sure), offsets == (0, 2))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _places(block: Block, hits: tuple[np.ndarray, ...], row: np.ndarray, need: np.ndarray, span: np.ndarray):
    """(row, item, first, last) of each stretch of a text with enough pairs of an item."""
    at, low, high, apart = hits
    n = high - low
    each = np.repeat(np.arange(len(at)), n)
    item = block.owner[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + low[each]]
    fits = ~apart[each] | (block.sizes()[item] > SHORT)
    each, item = each[fits], item[fits]
    key, position = row[each] * len(block.ids) + item, at[each]
    order = np.lexsort((position, key))
    key, position = key[order], position[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(position) != 0)
    key, position = key[new], position[new]
    item = key % len(block.ids)
    end = np.arange(len(key)) + need[item] - 1
    begin = np.flatnonzero(end < len(key))
    begin = begin[(key[end[begin]] == key[begin]) & (position[end[begin]] - position[begin] <= span[item[begin]])]
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end[begin] + 1, -1)
    inside = np.cumsum(cover[:-1]) > 0
    key, position, item = key[inside], position[inside], item[inside]
    cut = np.ones(len(key), bool)
    cut[1:] = (np.diff(key) != 0) | (np.diff(position) > span[item[1:]])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    return zip((key[first] // len(block.ids)).tolist(), item[first].tolist(), position[first].tolist(), position[last].tolist())


def _most(known: np.ndarray, edit: int) -> int:
    """A score that no alignment exceeds: each word of the passage counts on its own."""
    sums = np.cumsum(np.where(known, MATCH, edit))
    return int((sums - np.minimum.accumulate(np.minimum(np.append(0, sums[:-1]), 0))).max())


def _leaks(block: Block, w: words.Words, h: np.ndarray, places, span: np.ndarray, least: float) -> list[tuple]:
    """(row, item, similarity, from, to), one per row and item."""
    best: dict[tuple[int, int], tuple] = {}
    for row, item, first, last in places:
        own = block.hashes[item]
        full = MATCH * len(own)
        start = max(w.first[row], first - span[item])
        passage = h[start : min(w.first[row + 1], last + span[item] + SHORT)]
        ordered = np.sort(own)
        known = ordered[np.minimum(np.searchsorted(ordered, passage), len(own) - 1)] == passage
        # The whole item first; a long passage that is less of it, otherwise.
        for mismatch, gap, needed in ((MISMATCH, GAP, least * full), (EDIT, EDIT, MATCH * LONG_WORDS)):
            if full < needed or _most(known, max(mismatch, gap)) < needed:
                continue
            score, end = align(own, passage, mismatch, gap)
            if score < needed:
                continue
            similarity = score / full
            if (row, item) not in best or similarity > best[row, item][0]:
                # The same score backwards gives where the part begins.
                _, back = align(own[::-1], passage[:end][::-1], mismatch, gap)
                begin = int(start - w.first[row])
                best[row, item] = (similarity, begin + end - back, begin + end)
            break
    return [(*pair, *found) for pair, found in best.items()]


def _scan(block: Block, table: np.ndarray, batch: pa.RecordBatch, least: float):
    """For chunks of rows: the chunk, and (row, item, similarity, from, to)."""
    need, span = block.need(least)
    for rows, data, offsets in words.chunks(batch):
        w = words.words(data, offsets, words.NON_ALNUM, lower=True)
        h = w.hashes()
        hits = _hits(block, table, w, h)
        order = np.argsort(hits[0], kind="stable")
        hits = tuple(x[order] for x in hits)
        row = np.searchsorted(w.first, hits[0], side="right") - 1
        # Whole rows together, up to a number of pairs of hit and item.
        part = np.cumsum(hits[2] - hits[1]) // _HITS_AT_ONCE
        part = part[np.searchsorted(row, row)] if len(row) else part
        found = []
        for k in np.unique(part):
            own = slice(np.searchsorted(part, k), np.searchsorted(part, k, side="right"))
            places = _places(block, tuple(x[own] for x in hits), row[own], need, span)
            found += _leaks(block, w, h, places, span, least)
        yield rows, found


LEAKS = "doc_id bigint, item_id bigint, similarity double, from_word bigint, to_word bigint"


def find_leaks(docs: DataFrame, items: DataFrame, *, least: float = LEAST_SIMILARITY) -> DataFrame:
    """A row per text and item found in it: doc_id, item_id, similarity, and the
    best passage as a range of words (end exclusive).

    An item is found when its similarity, a share of the whole item, reaches
    ``least``, or by a passage in which LONG_WORDS more words match than are
    edited; the similarity then is that passage's share and may be lower.

    Clean texts give no row, nor do null or empty texts or items. An item of at
    most three words is found as a whole. Items with equal texts are all reported;
    a repeated row is reported each time, a row without doc_id with a null one.
    Other columns are ignored.
    """
    out = None
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            table = own.filter_table()
            for batch in batches:
                for rows, found in _scan(own, table, batch, least):
                    ids = rows.column("doc_id").to_pylist()
                    columns = list(zip(*[(ids[r], own.ids[i], s, a, b) for r, i, s, a, b in found])) or [[]] * 5
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)],
                        ["doc_id", "item_id", "similarity", "from_word", "to_word"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, items: DataFrame, *, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    out = docs
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            table = own.filter_table()
            for batch in batches:
                for rows, found in _scan(own, table, batch, least):
                    clean = np.ones(rows.num_rows, bool)
                    clean[[f[0] for f in found]] = False
                    yield rows.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out
