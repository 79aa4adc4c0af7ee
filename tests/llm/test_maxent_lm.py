import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_helpers import AWKWARD, prose, table, words_of
from pyspark.sql import functions as F

from visitlake.llm import maxent_lm as M
from visitlake.llm import tables


def tokens(text):
    return [*words_of(text, lower=True), None]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    languages = [lambda n: prose(rng, n, 120), lambda n: prose(rng, n, 120).replace("w", "q")]
    rows = [(i, languages[i % 2](rng.randrange(20, 90))) for i in range(500)]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "w1 w2"), rows[7], (2000, "unseen words only")]
    return table(spark, rows), rows


def test_counts_and_base_score_equal_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 50)  # most tokens go through the join
    docs, rows = data
    usable = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    scored, counts = M.language_model(docs, usable, tables.stage(spark, "t"))
    c = Counter(x for i, t in rows if i is not None and i % 5 != 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    assert (counts.total, counts.distinct) == (n, v)
    want = []
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x)
        want.append((i, len(x), sum(c[y] > 0 for y in x), round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_model_beats_counts_on_held_out_texts(spark, data):
    docs, _ = data
    usable = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    scored, _ = M.language_model(docs, usable, tables.stage(spark, "t"))
    held = [r for r in scored.collect() if r.doc_id is not None and r.doc_id % 5 == 1 and r.doc_id < 500]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_probabilities_add_up_to_one(spark, data):
    docs, _ = data
    counts = M.count_tokens(docs.select("doc_id", "text"), tables.stage(spark, "t"))[1]
    model = M.train(docs.select("doc_id", "text"), counts)
    assert np.any(model.class_weights) and np.any(model.pair_weights)
    rng = np.random.default_rng(1)
    history = rng.choice(counts.hashes, 20)
    features = model.features(history, np.array([0, 20]))
    classes = np.exp(model.class_log(model.slots(features)))
    assert np.allclose(classes.sum(1), 1, atol=1e-5)
    for c in range(0, M.CLASSES, 7):
        own = np.full(20, c)
        inside = np.exp(model.word_log(model.pair_slots(features, own), own))
        assert np.allclose(inside.sum(1), 1, atol=1e-4)


def test_empty_tables(spark, data):
    docs, rows = data
    scored, counts = M.language_model(docs, F.lit(False), tables.stage(spark, "t"))
    assert counts.total == 0 and scored.count() == len(rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in scored.collect())
    assert M.language_model(table(spark, []), F.lit(True), tables.stage(spark, "t"))[0].count() == 0


def test_every_training_text_counts(spark, monkeypatch):
    """Pairs of words that only few of many texts hold are learned."""
    rng = random.Random(8)
    plain = [prose(rng, 12, 60) for _ in range(14_000)]
    rare = ["v1 v2 v1 v2 v1 v2"] * 40
    rows = list(enumerate(plain + rare)) + [(1_000_000, "v1 v2")]
    usable = F.coalesce(F.col("doc_id") < 1_000_000, F.lit(False))
    docs = table(spark, rows).repartition(4, "doc_id")
    seen = spark.sparkContext.accumulator(0)
    update = M._update

    def counted(model, h, first, gathered):
        seen.add(len(first) - 1)
        update(model, h, first, gathered)

    monkeypatch.setattr(M, "_update", counted)
    scored, _ = M.language_model(docs, usable, tables.stage(spark, "t"))
    got = next(r for r in scored.collect() if r.doc_id == 1_000_000)
    assert seen.value == 14_040
    assert got.score > got.base_score


def test_few_texts_are_learned_like_many(spark, monkeypatch):
    """Each text takes part once, as in a large corpus."""
    rng = random.Random(9)
    docs = table(spark, [(i, prose(rng, 12, 60)) for i in range(300)]).repartition(4, "doc_id")
    seen = spark.sparkContext.accumulator(0)
    update = M._update

    def counted(model, h, first, gathered):
        seen.add(len(first) - 1)
        update(model, h, first, gathered)

    monkeypatch.setattr(M, "_update", counted)
    M.language_model(docs, F.lit(True), tables.stage(spark, "t"))
    assert seen.value == 300


def _plain_model(rng, words_held=400):
    hashes = np.sort(rng.integers(0, 1 << 63, words_held, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    counts = M.Counts(10 * words_held, words_held, hashes, np.full(words_held, 10))
    place = np.arange(words_held)
    members = np.zeros((M.CLASSES, M.CLASS_SIZE), np.uint64)
    word_bias = np.full(members.shape, -np.inf, np.float32)
    word_class, slot = place % M.CLASSES, place // M.CLASSES
    word_class[350:] = M.CLASSES
    members[word_class[:350], slot[:350]] = hashes[:350]
    word_bias[word_class[:350], slot[:350]] = -1.0
    return M.Model(
        counts, word_class, slot, members, np.full(M.CLASSES + 1, -4.0, np.float32), word_bias,
        np.zeros((M._TEMPLATES * M.SLOTS, M.CLASSES + 1), np.float32), np.zeros(1 << 10, np.float32),
    )


def _plain_update(model, h, first, squares):
    """The steps with every group sorted and added up at once."""
    at = model.counts.find(h)
    classes = np.where(at >= 0, model.word_class[at], M.CLASSES)
    slot = np.where(at >= 0, model.word_slot[at], 0)
    features = model.features(h, first)
    slots = model.slots(features)

    def step(weights, gathered, places, error):
        order = np.argsort(places, kind="stable")
        begin = np.flatnonzero(np.diff(places[order], prepend=-1))
        used, total = places[order[begin]], np.add.reduceat(error[order], begin, axis=0)
        gathered[used] += total * total
        weights[used] += M.STEP * total / np.sqrt(gathered[used] + 1.0)

    for low in range(0, len(h), 4096):
        part = slice(low, low + 4096)
        own = classes[part]
        error = -np.exp(model.class_log(slots[part]))
        error[np.arange(len(own)), own] += 1
        for t in range(M._TEMPLATES):
            step(model.class_weights, squares[0], slots[part][:, t], error)
        inside = np.flatnonzero(own < M.CLASSES)
        pairs = model.pair_slots(features[part][inside], own[inside])
        error = -np.exp(model.word_log(pairs, own[inside]))
        error[np.arange(len(inside)), slot[part][inside]] += 1
        step(model.pair_weights, squares[1], pairs.ravel(), error.ravel())


def test_steps_need_no_sort_of_pairs_and_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(5)
    fast, plain = (_plain_model(np.random.default_rng(4)) for _ in range(2))
    pairs = np.zeros((len(fast.pair_weights), 2), np.float32)
    squares = [np.zeros_like(plain.class_weights), np.zeros_like(plain.pair_weights)]
    gathered = [np.zeros_like(fast.class_weights), pairs]
    sorted_at_once, argsort = [], np.argsort
    for n in (1, 9_000, 5_000):
        h = fast.counts.hashes[np.minimum(rng.geometric(0.02, n), 399)]
        first = np.array([0, n // 2, n])
        with monkeypatch.context() as patch:
            patch.setattr(M.np, "argsort", lambda x, **how: (sorted_at_once.append(x.size), argsort(x, **how))[1])
            M._update(fast, h, first, gathered)
        _plain_update(plain, h, first, squares)
    assert max(sorted_at_once) <= 4096  # a block's pairs are up to 48 times as many
    assert np.abs(plain.pair_weights).max() > 0.1
    assert np.array_equal(fast.class_weights, plain.class_weights)
    assert np.array_equal(pairs[:, 0], plain.pair_weights)
    assert np.array_equal(pairs[:, 1], squares[1]) and np.array_equal(gathered[0], squares[0])


def test_frequent_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(6)
    near = np.arange(50, dtype=np.uint64) + (np.uint64(7) << np.uint64(60))
    ends = np.array([0, 2**64 - 1], np.uint64)
    hashes = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 3_000, dtype=np.uint64) * np.uint64(2), ends]))
    counts = M.Counts(1, 1, hashes, np.ones(len(hashes), np.int64))
    assert np.array_equal(counts.find(hashes), np.arange(len(hashes)))
    other = np.setdiff1d(np.concatenate([hashes + np.uint64(1), near - np.uint64(60)]), hashes)
    assert (counts.find(other) == -1).all()
    assert (M.Counts(0, 0, np.zeros(1, np.uint64), np.zeros(1, np.int64)).find(hashes[1:]) == -1).all()
