"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word
between, each hashed to one of DIMS slots. Every slot has a learning rate of its
own, and the L1 term sets the weights of uninformative slots to zero, so scoring
broadcasts a few non-zero weights. Training takes a bounded sample of the
labelled rows. Shards of it are trained in parallel; between rounds their states,
two numbers per slot, are summed in Spark, and one state comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm import tables, words

BITS = 19
DIMS = 1 << BITS
MAX_LABELLED = 24_000  # rows to fit on
SHARDS, SHARD_ROWS = 6, 2_000  # shards, and the least rows in one
ROUNDS = 3
PIECES = 16  # that the state is summed in
OFFSETS = ((0,), (0, 1), (0, 2))
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
POSITIVE = 2.0  # weight of a row with label 1


@dataclass
class State:
    """FTRL state of all slots; the last one is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> State:
        return cls(np.zeros(DIMS + 1), np.zeros(DIMS + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        )

    def learn(self, slots: np.ndarray, label: float) -> None:
        """One step on one text, given its distinct slots."""
        w = self.weights(slots)
        gradient = (_sigmoid(w.sum()) - label) * (POSITIVE if label else 1.0)
        squared = gradient * gradient
        rate = (np.sqrt(self.n[slots] + squared) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += gradient - rate * w
        self.n[slots] += squared


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots of all features of a chunk, the row each belongs to, and the rows."""
    w = words.words(data, offsets, words.NON_ALNUM, lower=True)
    h = w.hashes()
    row = w.row_of()
    slots, rows = [], []
    for kind in OFFSETS:
        grams, at = w.grams(h, kind)
        grams = words.mix(grams + np.uint64(kind[-1]))
        slots.append((grams >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[at])
    return np.concatenate(slots), np.concatenate(rows), w.rows


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable, limit: int | None = None) -> DataFrame:
    """doc_id, text, label of all usable labelled rows, or of about ``limit`` chosen by hash.

    Null labels and ids are left out; of several labels of one id the largest counts.
    """
    known = labels.filter(usable & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).cast("double").alias("label"))
    total = known.count()
    if limit is not None and total > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * limit // total)
        total = limit
    known = tables.small(known, total)
    return docs.select("doc_id", "text").join(known, "doc_id")


def _train_shards(start, dims: int):
    """Rows that come shard by shard to one state per shard, in pieces. How many shards a
    task gets, and how many tasks there are, has no influence."""

    def fresh() -> State:
        return State(start.value.z.astype(float), start.value.n.astype(float))

    def in_pieces(state: State) -> pa.RecordBatch:
        pieces = [np.array_split(x.astype(np.float32), PIECES) for x in (state.z, state.n)]
        arrays = [pa.array(range(PIECES), pa.int32()), pa.array([1] * PIECES, pa.int32())]
        arrays += [pa.array([x.tobytes() for x in own], pa.binary()) for own in pieces]
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECE)

    def run(batches):
        state, shard = None, None
        for batch in batches:
            for rows, data, offsets in words.chunks(batch):
                slots, row, count = slots_of(data, offsets)
                order = np.argsort(row, kind="stable")
                slots, cuts = slots[order], np.searchsorted(row[order], np.arange(count + 1))
                for i, (label, own) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("label", "shard")))):
                    if state is None or own != shard:
                        if state is not None:
                            yield in_pieces(state)
                        state, shard = fresh(), own
                    state.learn(np.append(np.unique(slots[cuts[i] : cuts[i + 1]]), dims), label)
        if state is not None:
            yield in_pieces(state)

    return run


def _summed(pieces: pa.Table) -> pa.Table:
    """One piece of the state, summed over the shards."""
    total = [
        np.sum([np.frombuffer(x, np.float32) for x in pieces.column(c).to_pylist()], axis=0, dtype=np.float32)
        for c in ("z", "n")
    ]
    held = pa.array([sum(pieces.column("shards").to_pylist())], pa.int32())
    return pa.table([pieces.column("piece")[:1], held, *(pa.array([t.tobytes()], pa.binary()) for t in total)], _PIECE)


_PIECE = pa.schema([("piece", pa.int32()), ("shards", pa.int32()), ("z", pa.binary()), ("n", pa.binary())])


def train(sample: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights as (slots, weights); the slot DIMS is the bias. Empty without rows."""
    context = sample.sparkSession.sparkContext
    shards = max(1, min(SHARDS, sample.count() // SHARD_ROWS))
    turn = F.xxhash64("doc_id", F.lit(2))
    dealt = sample.select("text", "label", turn.alias("turn"), F.pmod(turn, F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "turn").select("text", "label", "shard")
    state = State.empty()
    for _ in range(rounds):
        shared = context.broadcast(State(state.z.astype(np.float32), state.n.astype(np.float32)))
        state = State.empty()
        layout = "piece int, shards int, z binary, n binary"
        trained = dealt.mapInArrow(_train_shards(shared, DIMS), layout)
        rows = sorted(trained.groupBy("piece").applyInArrow(_summed, layout).collect())
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        state.z, state.n = (
            np.concatenate([np.frombuffer(r[c], np.float32) / r["shards"] for r in rows]).astype(float) for c in ("z", "n")
        )
        shared.unpersist()
    w = state.weights()
    nonzero = np.flatnonzero(w)
    return nonzero, w[nonzero].astype(np.float32)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every whole text; 0 without a trained model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at, w = shared.value
        table = np.zeros(DIMS + 1, np.float32)
        table[at] = w
        for batch in batches:
            for rows, data, offsets in words.chunks(batch):
                slots, row, count = slots_of(data, offsets)
                used = np.flatnonzero(table[slots])
                pairs = np.unique(row[used] * np.int64(DIMS) + slots[used])
                total = np.bincount(pairs // DIMS, table[pairs % DIMS], count) + table[DIMS]
                scores = _sigmoid(total) if len(at) else np.zeros(count)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(scores)], ["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, usable, column: str = "toxic") -> DataFrame:
    """A row per row of ``docs``: doc_id and score, from 0 to 1.

    ``usable`` is a condition on doc_id for the labelled rows to learn from. A
    null or empty text has no features and gets the score of the bias alone.
    Other columns are ignored; repeated rows are scored alike.
    """
    return score(docs, train(labelled_sample(docs, labels, column, usable, MAX_LABELLED)))
