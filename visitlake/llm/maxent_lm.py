"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

P(token | history) = P(class | history) P(token | class, history). Both factors
are softmaxes over hashed features of the history: the last word, the word before
it (a skip feature) and the pair of them. The frequent words of the corpus are
dealt to classes of equal size by the company they keep; all other tokens form
one class, in which probability follows the smoothed count.

Counts cover all training texts: they are summed in Spark and stay there as a
table. The counts of the most frequent words, a fixed number, are broadcast;
the others are joined by hash. The softmax weights are fitted on all training texts
by rounds of distributed gradient updates: each shard, some partitions where they
lie, runs through its texts and the changes are averaged, summed in pieces in Spark.
Texts are dealt to the rounds by hash, each to one, however many there are. Texts
are scored in numpy, some thousand tokens at
a time, with one gather of a weight row per feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm import words
from visitlake.sources.staging import Staging

END = np.uint64(0x8D8F3A1B4C6E2F57)  # stands for the end of a text
FREQUENT = 200_000  # words, at most, whose counts are broadcast
CLASSES, CLASS_SIZE = 64, 48
CONTEXT_WORDS = 128  # frequent words that describe the company of others
SLOTS = 1 << 12  # per feature template of a class
# Features of words within classes: this many bits at least and at most, a slot for some tokens.
PAIR_BITS, MOST_PAIR_BITS, TOKENS_A_SLOT = 18, 22, 32
SHARDS, SHARD_TEXTS, ROUNDS = 6, 16_000, 3  # least number of shards, texts in each of more
PIECES = 64  # that changes are summed in
STEP = 0.25
FIND_BITS = 20  # several times as many places as there are frequent words
BLOCK_TOKENS = 4096  # of a step; their scores stay in a core's cache
IN_TURN = 8  # rows of a group, at most, that are added by turns: the first ones, the second ones, ...
_PLACE_BITS = (BLOCK_TOKENS * CLASS_SIZE).bit_length()
_BIGRAM = np.uint64(0xC2B2AE3D27D4EB4F)
_TEMPLATES = 3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each row closed by END, and the rows' offsets."""
    w = words.words(data, offsets, lower=True)
    h = w.hashes()
    first = w.first + np.arange(w.rows + 1)
    out = np.full(len(h) + w.rows, END, np.uint64)
    out[np.arange(len(h)) + w.row_of()] = h
    return out, first


@dataclass
class Counts:
    """Totals, and the most frequent tokens with their counts, sorted by hash."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray

    @cached_property
    def _starts(self) -> np.ndarray:
        """Places from which to look for hashes, by their first bits."""
        bits = np.arange(1 << FIND_BITS, dtype=np.uint64) << np.uint64(64 - FIND_BITS)
        return np.searchsorted(self.hashes, bits).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each token, or -1."""
        at = self._starts[h >> np.uint64(64 - FIND_BITS)].astype(np.int64)
        last = len(self.hashes) - 1
        np.minimum(at, last, out=at)
        found = self.hashes[at]
        left = np.flatnonzero(found < h)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            found[left] = self.hashes[at[left]]
            left = left[found[left] < h[left]]
        at[found != h] = -1
        return at


def count_tokens(docs: DataFrame, staging: Staging) -> tuple[DataFrame, Counts]:
    """The table (token, n) of all tokens of ``docs``, and its head."""

    def run(batches):
        for batch in batches:
            seen = [tokens(data, offsets)[0] for _, data, offsets in words.chunks(batch)]
            if seen:
                h, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.signed(h)), pa.array(n)], ["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token bigint, n bigint")
    table = staging.write(counted.groupBy("token").agg(F.sum("n").alias("n")), "counts")
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The head is cut at a count, by classes of counts, so nothing has to be sorted.
    size = F.floor(F.log2("n") * 32).alias("size")
    least, held = None, 0
    for row in sorted(table.groupBy(size).count().collect(), reverse=True):
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["size"]
    head = table.filter(F.lit(False) if least is None else size >= least).toArrow()
    h, n = head.column("token").to_numpy().view(np.uint64), head.column("n").to_numpy()
    if not len(h):  # a stand-in that no text has
        h, n = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    order = np.argsort(h)
    return table, Counts(totals[0], totals[1], h[order], n[order])


@dataclass
class Model:
    counts: Counts
    word_class: np.ndarray  # by place in counts; CLASSES for words outside
    word_slot: np.ndarray
    members: np.ndarray  # CLASSES x CLASS_SIZE hashes
    class_bias: np.ndarray
    word_bias: np.ndarray  # log-probability in the class; -inf where a class has no such member
    class_weights: np.ndarray  # _TEMPLATES * SLOTS x CLASSES + 1
    pair_weights: np.ndarray

    def features(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """_TEMPLATES hashes of the history of each token."""
        one = np.zeros_like(h)
        one[1:] = h[:-1]
        one[first[:-1]] = 0
        two = np.zeros_like(h)
        two[1:] = one[:-1]
        two[first[:-1]] = 0
        return np.stack([words.mix(one), words.mix(two + np.uint64(1)), words.mix(one * _BIGRAM + two)], 1)

    def slots(self, features: np.ndarray) -> np.ndarray:
        return (features >> np.uint64(52)).astype(np.int64) + np.arange(_TEMPLATES) * SLOTS

    def class_scores(self, slots: np.ndarray) -> np.ndarray:
        x = self.class_weights.take(slots[:, 0], 0)
        x += self.class_bias
        for t in range(1, _TEMPLATES):
            x += self.class_weights.take(slots[:, t], 0)
        return x

    def class_log(self, slots: np.ndarray) -> np.ndarray:
        return _log_softmax(self.class_scores(slots))

    def pair_slots(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Slots of (last word, member) for all members of each token's class."""
        mixed = (features[:, :1] ^ self.members[classes]) * _BIGRAM
        bits = len(self.pair_weights).bit_length() - 1
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def word_scores(self, pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
        x = self.pair_weights.take(pairs)
        x += self.word_bias.take(classes, 0)
        return x

    def word_log(self, pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return _log_softmax(self.word_scores(pairs, classes))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """``x`` is used up."""
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def _log_of(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One entry of each row's log softmax; ``x`` is used up."""
    x -= x.max(1, keepdims=True)
    picked = x[np.arange(len(own)), own]
    np.exp(x, out=x)
    return picked - np.log(x.sum(1))


def _error_of(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What is missing from the softmax of each row to certainty of one entry."""
    x = _log_softmax(x)
    np.exp(x, out=x)
    np.negative(x, out=x)
    x[np.arange(len(own)), own] += 1
    return x


def _company(docs: DataFrame, counts: Counts, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word stands before and after each context word; summed in Spark."""
    order = np.argsort(-counts.counts[vocabulary], kind="stable")
    context = np.full(len(counts.hashes), -1)
    context[vocabulary[order[:CONTEXT_WORDS]]] = np.arange(min(CONTEXT_WORDS, len(vocabulary)))
    place = np.full(len(counts.hashes), -1)
    place[vocabulary] = np.arange(len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((counts, context, place))
    width = 2 * CONTEXT_WORDS

    def run(batches):
        counts, context, place = shared.value
        for batch in batches:
            for _, data, offsets in words.chunks(batch):
                h, _ = tokens(data, offsets)
                at = counts.find(h)
                ctx, who = np.where(at >= 0, context[at], -1), np.where(at >= 0, place[at], -1)
                cells = np.zeros(int(place.max() + 1) * width, np.int64)
                for a, b, shift in ((who[1:], ctx[:-1], 0), (who[:-1], ctx[1:], CONTEXT_WORDS)):
                    both = (a >= 0) & (b >= 0)
                    cells += np.bincount(a[both] * width + b[both] + shift, minlength=len(cells))
                cell = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cells[cell])], ["cell", "n"])

    summed = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = summed.orderBy("cell").toArrow()  # bounded: vocabulary x contexts
    matrix = np.zeros(len(vocabulary) * width)
    matrix[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return matrix.reshape(len(vocabulary), width)


def _classes(company: np.ndarray) -> list[np.ndarray]:
    """Words in CLASSES groups of nearly equal size, by halving along the main direction."""
    x = np.sqrt(company / np.maximum(company.sum(1, keepdims=True), 1))
    groups = [np.arange(len(x))]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            if len(g) < 2:
                halves += [g, g[:0]]
                continue
            centred = x[g] - x[g].mean(0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ main, kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    return groups


def _start(docs: DataFrame, counts: Counts) -> Model:
    """The model before training: classes and smoothed counts, no history."""
    order = np.lexsort((counts.hashes, -counts.counts))
    vocabulary = order[: CLASSES * CLASS_SIZE]
    vocabulary = vocabulary[counts.counts[vocabulary] > 0]
    groups = _classes(_company(docs, counts, vocabulary)) if len(vocabulary) else [np.zeros(0, int)] * CLASSES
    word_class = np.full(len(counts.hashes), CLASSES)
    word_slot = np.zeros(len(counts.hashes), np.int64)
    members = np.zeros((CLASSES, CLASS_SIZE), np.uint64)
    word_bias = np.full((CLASSES, CLASS_SIZE), -np.inf, np.float32)
    mass = np.zeros(CLASSES + 1)
    for c, group in enumerate(groups):
        at = vocabulary[group]
        word_class[at], word_slot[at] = c, np.arange(len(at))
        members[c, : len(at)] = counts.hashes[at]
        mass[c] = counts.counts[at].sum()
        if len(at):
            word_bias[c, : len(at)] = np.log(counts.counts[at] / mass[c])
        else:
            word_bias[c, 0] = 0.0
    mass[CLASSES] = counts.total - mass.sum() + 0.5
    with np.errstate(divide="ignore"):
        class_bias = np.log(mass / mass.sum()).astype(np.float32)
    class_bias = np.maximum(class_bias, -40)
    bits = min(max((counts.total // TOKENS_A_SLOT).bit_length(), PAIR_BITS), MOST_PAIR_BITS)
    return Model(
        counts, word_class, word_slot, members, class_bias, word_bias,
        np.zeros((_TEMPLATES * SLOTS, CLASSES + 1), np.float32), np.zeros(1 << bits, np.float32),
    )


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Whether a group of equal values begins here."""
    out = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def _sums(x: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the groups that begin at these places of the order, each the first entry
    and what ``np.add.reduce`` makes of the others."""
    begin = np.flatnonzero(begins)
    sums = x.take(order[begin], 0)
    # Most groups have one entry; only the others are added up.
    several = ~begins
    several[:-1] |= ~begins[1:]
    if x.ndim == 1:
        if several.any():
            sums[several[begin]] = np.add.reduceat(x[order[several]], np.flatnonzero(begins[several]))
        return sums
    sizes = np.diff(begin, append=len(order))
    few = np.flatnonzero((sizes > 1) & (sizes <= IN_TURN))
    few = few[np.argsort(-sizes[few], kind="stable")]
    if len(few):
        rest = x.take(order[begin[few] + 1], 0)
        for nth in range(2, sizes[few[0]]):
            longer = few[: np.searchsorted(-sizes[few], -nth)]
            rest[: len(longer)] += x.take(order[begin[longer] + nth], 0)
        sums[few] += rest
    many = sizes > IN_TURN
    if many.any():
        several = np.repeat(many, sizes)
        sums[many] = np.add.reduceat(x.take(order[several], 0), np.flatnonzero(begins[several]), axis=0)
    return sums


def _step(weights: np.ndarray, squares: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Weights after an Adagrad step, in place of it; the gathered squares grow."""
    root = step * step
    squares += root
    np.add(squares, np.float32(1), out=root)
    np.sqrt(root, out=root)
    step *= np.float32(STEP)
    step /= root
    step += weights
    return step


def _update(model: Model, h: np.ndarray, first: np.ndarray, gathered: list[np.ndarray]) -> None:
    """Adagrad steps over a chunk of tokens, in blocks. ``gathered`` has the squares of
    classes, and the weights and squares of pairs, which move together as 64 bits."""
    class_squares, pair_state = gathered
    moved = pair_state.view(np.int64)[:, 0]
    at = model.counts.find(h)
    classes = np.where(at >= 0, model.word_class[at], CLASSES)
    slot = np.where(at >= 0, model.word_slot[at], 0)
    features = model.features(h, first)
    slots = model.slots(features)
    for low in range(0, len(h), BLOCK_TOKENS):
        part = slice(low, low + BLOCK_TOKENS)
        own, s = classes[part], slots[part]
        error = _error_of(model.class_scores(s), own)
        for t in range(_TEMPLATES):
            # NumPy sorts numbers of 16 bits by radix.
            order = np.argsort(s[:, t].astype(np.uint16), kind="stable")
            ordered = s[order, t]
            begins = _begins(ordered)
            used = ordered[begins]
            squares = class_squares.take(used, 0)
            model.class_weights[used] = _step(model.class_weights.take(used, 0), squares, _sums(error, order, begins))
            class_squares[used] = squares
        inside = np.flatnonzero(own < CLASSES)
        if not len(inside):
            continue
        pairs = model.pair_slots(features[part][inside], own[inside])
        before = moved.take(pairs.ravel()).view(np.float32).reshape(-1, 2)
        scores = before[:, 0].reshape(pairs.shape) + model.word_bias.take(own[inside], 0)
        error = _error_of(scores, slot[part][inside]).ravel()
        # Slot and place in one number, as plain sorting is several times as fast as argsort.
        ordered = np.sort(pairs.ravel() << _PLACE_BITS | np.arange(pairs.size))
        order, ordered = ordered & (1 << _PLACE_BITS) - 1, ordered >> _PLACE_BITS
        begins = _begins(ordered)
        state = before.take(order[begins], 0)
        state[:, 0] = _step(state[:, 0], state[:, 1], _sums(error, order, begins))
        moved[ordered[begins]] = state.view(np.int64)[:, 0]


def _shard(shared):
    def run(batches):
        model = shared.value
        before = model.class_weights, model.pair_weights
        model.class_weights = before[0].copy()
        pairs = np.zeros((len(before[1]), 2), np.float32)
        pairs[:, 0] = before[1]
        gathered = [np.zeros_like(before[0]), pairs]
        for batch in batches:
            for _, data, offsets in words.chunks(batch):
                _update(model, *tokens(data, offsets), gathered)
        change = np.concatenate([(model.class_weights - before[0]).ravel(), pairs[:, 0] - before[1]])
        model.class_weights = before[0]
        pieces = [x.tobytes() for x in np.array_split(change.astype(np.float16), PIECES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "change"]
        )

    return run


def _summed(batches):
    """Sum of the changes of each piece; one after the other, so any number of shards fits."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, change in zip(b.column("piece").to_pylist(), b.column("change").to_pylist()):
            x = np.frombuffer(change, np.float16).astype(np.float32)
            total[piece] = total[piece] + x if piece in total else x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        ["piece", "change"],
    )


def train(docs: DataFrame, counts: Counts) -> Model:
    """Fit on all of ``docs``."""
    context = docs.sparkSession.sparkContext
    model = _start(docs.select("text"), counts)
    if not counts.total:
        return model
    n = docs.count()
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(ROUNDS))
    layout = "piece int, change binary"
    for k in range(ROUNDS):
        dealt = docs.filter(turn == k).select("text").coalesce(max(SHARDS, n // SHARD_TEXTS))
        shards = dealt.rdd.getNumPartitions()
        shared = context.broadcast(model)
        changes = dealt.mapInArrow(_shard(shared), layout).repartition(PIECES, "piece")
        # One row per piece, together the size of the model.
        rows = sorted(changes.mapInArrow(_summed, layout).collect())
        change = np.concatenate([np.frombuffer(row["change"], np.float32) for row in rows]) / shards
        size = model.class_weights.size
        model.class_weights += change[:size].reshape(model.class_weights.shape)
        model.pair_weights += change[size:]
        shared.unpersist()
    return model


PARTS = "row bigint, doc_id bigint, token bigint, times bigint, n_tokens bigint, n_known bigint, base double, model double"


def _score_parts(model: Model):
    """Per text one row with what the frequent tokens give, and a row per other token."""
    counts = model.counts
    norm = np.log10(counts.total + 0.5 * (counts.distinct + 1))
    base_log = np.log10(counts.counts + 0.5) - norm

    def scored(h: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
        at = model.counts.find(h)
        classes = np.where(at >= 0, model.word_class[at], CLASSES)
        slot = np.where(at >= 0, model.word_slot[at], 0)
        features = model.features(h, first)
        slots = model.slots(features)
        out = np.zeros(len(h))
        for low in range(0, len(h), BLOCK_TOKENS):
            part = slice(low, low + BLOCK_TOKENS)
            out[part] = _log_of(model.class_scores(slots[part]), classes[part])
        # Words of a class after the same word share a softmax.
        inside = np.flatnonzero(classes < CLASSES)
        key = words.mix(features[inside, 0] ^ (classes[inside].astype(np.uint64) * _BIGRAM))
        bits = np.uint64(max(len(inside), 1).bit_length())
        # Sorted by hash with the place in the last bits, as that sorts several times as fast.
        ordered = np.sort(key >> bits << bits | np.arange(len(inside), dtype=np.uint64))
        order = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = inside[order]
        begins = _begins(features[inside, 0]) | _begins(classes[inside])
        begin = np.flatnonzero(begins)
        for low in range(0, len(begin), BLOCK_TOKENS):
            first_of = inside[begin[low : low + BLOCK_TOKENS]]
            high = begin[low + BLOCK_TOKENS] if low + BLOCK_TOKENS < len(begin) else len(inside)
            own = inside[begin[low] : high]
            pairs = model.pair_slots(features[first_of], classes[first_of])
            logs = _log_softmax(model.word_scores(pairs, classes[first_of]))
            out[own] += logs[np.cumsum(begins[begin[low] : high]) - 1, slot[own]]
        return at, out / np.log(10)

    return scored, base_log


def score(docs: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score."""
    counts = model.counts
    inside = model.word_class < CLASSES
    rest_total = counts.total - int(counts.counts[inside].sum())
    rest_distinct = counts.distinct - int(inside.sum())
    rest_norm = float(np.log10(rest_total + 0.5 * (rest_distinct + 1)))
    norm = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scored, base_log = _score_parts(model)
        rest = np.log10(model.counts.counts + 0.5) - rest_norm
        for batch in batches:
            for rows, data, offsets in words.chunks(batch):
                h, first = tokens(data, offsets)
                at, logs = scored(h, first, model)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                known = at >= 0
                outside = known & (model.word_class[at] == CLASSES)
                logs[outside] += rest[at[outside]]
                base = np.where(known, base_log[at], 0.0)
                n = len(first) - 1
                sums = [np.bincount(row, x, n) for x in (base, logs)]
                own = np.asarray(rows.column("row").to_numpy())
                # Tokens that are not frequent: once per text, with their number.
                other = np.flatnonzero(~known)
                order = other[np.lexsort((h[other], row[other]))]
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0)
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(order)))
                picked = order[begin]
                m = len(picked)
                ids = rows.column("doc_id").cast(pa.int64())
                zero = np.zeros(m)
                # A token of its own keeps the row of a text from meeting others in the join.
                alone = words.signed(words.mix(own.astype(np.uint64) ^ _BIGRAM))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, own[row[picked]]])),
                        pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                        pa.array(np.concatenate([alone, words.signed(h[picked])])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                        pa.array(np.concatenate([np.diff(first), zero.astype(np.int64)])),
                        pa.array(np.concatenate([np.bincount(row, known, n).astype(np.int64), zero.astype(np.int64)])),
                        pa.array(np.concatenate([sums[0], zero])),
                        pa.array(np.concatenate([sums[1], zero])),
                    ],
                    [x.split()[0] for x in PARTS.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(run, PARTS).join(table, "token", "left")
    count = F.coalesce("n", F.lit(0))
    log = F.log10(count + 0.5)
    return (
        parts.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(count > 0, F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.col("times") * (log - norm)).alias("base_score"),
            F.sum(F.col("model") + F.col("times") * (log - rest_norm)).alias("score"),
        )
        .drop("row")
    )


def language_model(docs: DataFrame, usable, staging: Staging) -> tuple[DataFrame, Counts]:
    """Scores of every whole text, learned from the rows that meet ``usable``.

    Returns (doc_id, n_tokens, n_known, base_score, score) and the counts. base_score
    is the log10 probability under smoothed counts, score that of the model. A null
    text counts as an empty one, which has one token, the end. Repeated rows are
    scored alike, each on its own. Other columns are ignored. Without training
    tokens every token gets the same probability.
    """
    training = docs.filter(usable).select("doc_id", "text")
    table, counts = count_tokens(training, staging)
    return score(docs, table, train(training, counts)), counts
