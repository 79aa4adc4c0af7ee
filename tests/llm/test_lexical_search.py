import math
import random
import re

import numpy as np
import pytest
from llm_helpers import AWKWARD, prose, table
from pyspark.sql import types as T

from visitlake.llm import lexical_search as L
from visitlake.llm import tables

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    total, n_docs = sum(len(t) for _, t in docs), len(docs)
    df = {}
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        found = []
        for doc, t in docs:
            m = 50 + 50 * len(t) * n_docs // total
            score = 0
            for term in set(terms(text)) & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * (1000000000 * t.count(term) // (1000 * t.count(term) + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, f[2], -f[0]) for rank, f in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=5):
    found = L.search(table(spark, docs), spark.createDataFrame([(*i, "x") for i in items], ITEM), tables.stage(spark, "t"), k=k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def corpus(rng):
    docs = [(i, prose(rng, rng.randrange(1, 60), 120)) for i in range(150)]
    docs += [(1_000 - i, "same words here W5 w5") for i in range(40)]  # ties, more than k
    docs += list(enumerate(AWKWARD, 2_000)) + [(None, "w1 w2 w3"), (None, None), (7, docs[7][1]), (7, docs[7][1])]
    rng.shuffle(docs)
    items = [(i, prose(rng, rng.randrange(1, 40), 150)) for i in range(30)]
    items += [(100, None), (101, ""), (102, "--- !"), (None, "w1 W2"), (3, "same here"), (3, "same here"), (5, "é ß\x85ñ a")]
    return docs, items


@pytest.mark.parametrize("sizes", [(256, 1024, 512, 200_000), (3, 7, 5, 200_000), (4, 1024, 16, 60)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("TILE_ITEMS", "TILE_TERMS", "TILE_DOCS", "BLOCK_TERMS"), sizes):
        monkeypatch.setattr(L, name, size)
    docs, items = corpus(random.Random(sizes[0]))
    assert run(spark, docs, items) == brute(docs, items, 5)


def test_few_rows_are_merged_often(spark, monkeypatch):
    monkeypatch.setattr(L, "_MERGE_ROWS", 10)
    docs, items = corpus(random.Random(9))
    assert run(spark, docs, items, 2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == []
    assert run(spark, [(1, None), (2, "--")], [(1, "a")]) == []


def test_products_are_exact_at_the_bound():
    n = L.TILE_TERMS * 3
    impact = L.IMPACT // L.SCALE - 1
    items = L.Items([1], [np.arange(n)])
    tile = L.tiles(items, np.full(n, L.MOST_WEIGHT - 1))[0]
    got = tile.scores(1, np.zeros(n, np.int64), np.arange(n), np.full(n, impact))
    assert got[0, 0] == n * (L.MOST_WEIGHT - 1) * impact


def test_a_very_long_text(spark):
    rng = random.Random(2)
    docs = [(1, prose(rng, 300_000, 4_000)), (2, "w1 w1 w2"), (3, "w9")]
    items = [(1, "w1 w2 w9 w3999")]
    assert run(spark, docs, items) == brute(docs, items, 5)
