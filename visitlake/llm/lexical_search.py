"""Ranked lexical search: blocked products of item weights and document impacts.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z folded.
A term's impact in a document grows with its occurrences and falls with the document's
length against the mean; a score is the sum of weight times impact over an item's terms.

*Terms.* One scan keeps, per document, its length and the occurrences of the terms that
items use; document counts, from which weights follow, are sums over that table. Items
are taken in blocks of at most ``BLOCK_TERMS`` terms, whose hashes are broadcast; each
block is a scan of its own, so the size of the benchmark bounds nothing.

*Products.* Items go in tiles of ``TILE_ITEMS`` with the vocabulary of these items alone,
documents in tiles of ``TILE_DOCS``. The impacts of a tile times the weights of a
vocabulary tile is a dense BLAS product in float64. All figures are whole numbers: with
impacts under 10^6, weights under 2^16 and ``TILE_TERMS`` terms a product stays below
2^53 and is exact, and products are added as 64-bit integers.

*Top k.* A task keeps the best k documents of each item seen so far; only scores from the
k-th one on enter, and equal scores go by id, so nothing that ties is lost. A window over
k rows per item and task gives the ranks.

A null or empty text has no term, counts nowhere and is never found; an item without
terms finds nothing. Each row is a document, and each row of items an item, with its own
ranks, also where ids repeat; null ids come last among equals. Texts of any length are
scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlake.llm import words
from visitlake.sources.staging import Staging

BLOCK_TERMS = 200_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 1024, 512
# Fixed values of the score.
IMPACT, SCALE, LENGTH_PARTS, LENGTH_SHARE = 1_000_000_000, 1000, 100, 50
LENGTH_WEIGHT = 20
MOST_WEIGHT = 1 << 16
assert TILE_TERMS * MOST_WEIGHT * (IMPACT // SCALE) < 1 << 53
_MERGE_ROWS = 100_000


@dataclass
class Items:
    """Items of a block: the sorted hashes of all their terms, and each one's terms by
    place in these."""

    ids: list = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def closed(self) -> Items:
        self.hashes = np.unique(np.concatenate(self.terms))
        self.terms = [np.searchsorted(self.hashes, t) for t in self.terms]
        return self


def item_blocks(items: DataFrame, item_id: str = "item_id") -> Iterator[Items]:
    """The items that have terms, in blocks of bounded size."""
    block, held = Items(), 0
    for row in items.select(F.col(item_id).alias("id"), "text").orderBy("id", "text").toLocalIterator():
        raw = np.frombuffer((row["text"] or "").encode(), np.uint8)
        terms = np.unique(words.words(raw, np.array([0, len(raw)]), words.NON_ALNUM, lower=True).hashes())
        if not len(terms):
            continue
        if held and held + len(terms) > BLOCK_TERMS:
            yield block.closed()
            block, held = Items(), 0
        block.ids.append(row["id"])
        block.terms.append(terms)
        held += len(terms)
    if held:
        yield block.closed()


def _occurrences(batches: Iterator[pa.RecordBatch], hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, text to id, n (terms with repeats), terms (places in ``hashes``) and tf."""
    for batch in batches:
        for part, data, offsets in words.chunks(batch):
            found = words.words(data, offsets, words.NON_ALNUM, lower=True)
            h = found.hashes()
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            hit = hashes[at] == h
            pairs, tf = np.unique(found.row_of()[hit] * len(hashes) + at[hit], return_counts=True)
            first = np.searchsorted(pairs, np.arange(found.rows + 1) * len(hashes)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(found.counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first), pa.array(pairs % len(hashes), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(first), pa.array(tf, pa.int64())),
                ],
                names=["id", "n", "terms", "tf"],
            )
            yield out.filter(pa.array(found.counts > 0))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)


@dataclass
class Tile:
    """Some items, the places of their terms, and a term-by-item list of weights."""

    low: int
    n_items: int
    vocabulary: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def scores(self, n_docs: int, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Document-by-item scores; ``docs`` are numbers from 0, one term of one a row."""
        place = np.searchsorted(self.vocabulary, terms)
        place[place == len(self.vocabulary)] = 0
        inside = self.vocabulary[place] == terms
        docs, place, impacts = docs[inside], place[inside], impacts[inside]
        total = np.zeros((n_docs, self.n_items), np.int64)
        for low in range(0, len(self.vocabulary), TILE_TERMS):
            width = min(TILE_TERMS, len(self.vocabulary) - low)
            here = (place >= low) & (place < low + width)
            left = np.zeros((n_docs, width))
            left[docs[here], place[here] - low] = impacts[here]
            mine = (self.rows >= low) & (self.rows < low + width)
            right = np.zeros((width, self.n_items))
            right[self.rows[mine] - low, self.columns[mine]] = self.values[mine]
            total += (left @ right).astype(np.int64)
        return total


def tiles(items: Items, weight: np.ndarray) -> list[Tile]:
    out = []
    for low in range(0, len(items.terms), TILE_ITEMS):
        own = items.terms[low : low + TILE_ITEMS]
        used = np.concatenate(own)
        vocabulary, rows = np.unique(used, return_inverse=True)
        columns = np.repeat(np.arange(len(own)), [len(t) for t in own])
        out.append(Tile(low, len(own), vocabulary, rows, columns, weight[used]))
    return out


class Best:
    """The k best documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # a score under this one cannot be among them
        self.tables: list[pa.Table] = []
        self.held = self.kept = 0

    def add(self, low: int, scores: np.ndarray, ids: pa.Array) -> None:
        docs, items = np.nonzero(scores >= self.least[low : low + scores.shape[1]])
        if len(docs):
            columns = {"item": items + low, "score": scores[docs, items], "id": ids.take(pa.array(docs))}
            self.tables.append(pa.table(columns))
            self.held += len(docs)
            if self.held > 2 * self.kept + _MERGE_ROWS:
                self.merge()

    def merge(self) -> pa.Table | None:
        if not self.tables:
            return None
        rows = pa.concat_tables(self.tables)
        keys = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
        item = rows.column("item").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        full = rank == self.k - 1
        self.least[item[full]] = rows.column("score").to_numpy()[full]
        rows = rows.filter(pa.array(rank < self.k))
        self.tables, self.held, self.kept = [rows], rows.num_rows, rows.num_rows
        return rows


def _search(
    batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    best, parts = Best(len(items.ids), k), tiles(items, weight)
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_DOCS):
            rows = batch.slice(start, TILE_DOCS)
            # Whole numbers of any size: n and both totals grow with the corpus.
            lengths = np.array(
                [LENGTH_PARTS - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in rows.column("n").to_pylist()], np.int64
            )
            sizes = pc.list_value_length(rows.column("terms")).to_numpy()
            docs = np.repeat(np.arange(rows.num_rows), sizes)
            tf = rows.column("tf").flatten().to_numpy()
            terms = rows.column("terms").flatten().to_numpy()
            impacts = IMPACT * tf // (SCALE * tf + LENGTH_WEIGHT * lengths[docs])
            for tile in parts:
                best.add(tile.low, tile.scores(rows.num_rows, docs, terms, impacts), rows.column("id"))
    found = best.merge()
    if found is not None:
        yield from found.to_batches(max_chunksize=10_000)


def search(
    docs: DataFrame, items: DataFrame, staging: Staging, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the best ``k`` documents of each item."""
    texts = docs.select(F.col(doc_id).alias("id"), "text")
    kind, item_kind = (frame.schema[c].dataType.simpleString() for frame, c in ((docs, doc_id), (items, item_id)))
    spark, results = docs.sparkSession, []
    for number, block in enumerate(item_blocks(items, item_id)):
        hashes = block.hashes
        rows = texts.mapInArrow(lambda batches, h=hashes: _occurrences(batches, h), f"id {kind}, n bigint, terms array<int>, tf array<bigint>")
        rows = staging.write(rows, f"occurrences-{number}")
        totals = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
        counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(hashes), np.int64)
        df[counted.column("term").to_numpy()] = counted.column("count").to_numpy()
        weight = weights(totals["n_docs"], df)
        block.hashes = hashes[:0]  # the tiles go by place

        def look(batches, block=block, weight=weight, totals=totals):
            return _search(batches, block, weight, totals["n_docs"], totals["n_terms"], k)

        best = rows.mapInArrow(look, f"item bigint, score bigint, id {kind}")
        named = spark.createDataFrame(list(enumerate(block.ids)), f"item bigint, item_id {item_kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        results.append(ranked.join(F.broadcast(named), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
