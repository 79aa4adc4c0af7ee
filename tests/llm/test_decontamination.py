import random

import numpy as np
from llm_helpers import AWKWARD, edited, prose, table

from visitlake.llm import decontamination as D


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(
                0, h[i - 1, j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP
            )
    return int(h.max())


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        assert D.align(a, b)[0] == slow_align(a, b)


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, doc_id string, key string")


def test_exact_and_edited_copies_are_found_and_clean_texts_left(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 90)  # several blocks
    rng = random.Random(3)
    tests = [(i, prose(rng, 40, 5000)) for i in range(8)] + [(90, None), (91, ""), (92, "single"), (93, tests_two := "two words")]
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    want = set()
    for k in range(30):
        item, text = tests[k % 8]
        copy = [text, text.upper(), edited(rng, text, 0.1), ", ".join(text.split())][k % 4]
        rows.append((100 + k, f"{prose(rng, 300, 5000)} {copy} {prose(rng, 200, 5000)}"))
        want.add((100 + k, item))
    rows += [(200 + k, prose(rng, 400, 5000)) for k in range(20)]
    rows += [(300, f"so {tests_two} here"), (100, rows[len(AWKWARD)][1]), (None, tests[0][1])]
    want |= {(300, 93), (None, 0)}
    docs, bench = table(spark, rows), items(spark, tests)
    found = D.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert sum((r.doc_id, r.item_id) == (100, 0) for r in found) == 2
    assert all(0.5 <= r.similarity <= 1 and r.from_word < r.to_word for r in found)
    exact = next(r for r in found if r.doc_id == 100)
    assert (exact.similarity, exact.from_word, exact.to_word) == (1.0, 300, 340)
    clean = D.drop_leaks(docs, bench)
    assert clean.columns == docs.columns
    left = [r.doc_id for r in clean.collect()]
    assert sorted(left) == sorted(i for i, _ in rows if i is not None and i not in {d for d, _ in want})


def test_an_item_in_every_text_keeps_its_seeds(spark):
    rng = random.Random(4)
    item = prose(rng, 30, 5000)
    docs = table(spark, [(i, f"{prose(rng, 50, 5000)} {item}") for i in range(40)])
    assert D.find_leaks(docs, items(spark, [(1, item)])).count() == 40


def test_empty_tables(spark):
    docs, none = table(spark, [(1, "a b c")]), items(spark, [])
    assert D.find_leaks(docs, none).count() == 0 and D.drop_leaks(docs, none).count() == 1
    assert D.find_leaks(table(spark, []), items(spark, [(1, "a b c")])).count() == 0


def test_heavily_edited_copies_are_found_whatever_else_leaked(spark):
    """All copies that the plain recurrence puts over the least similarity, with and without a verbatim leak."""
    rng = random.Random(5)
    tests, rows, want = [], [], set()
    for i in range(60):
        item = prose(rng, rng.choice([15, 20, 30, 40, 60]), 4000)
        tests.append((i, item))
        copy = edited(rng, item, rng.choice([0.15, 0.2, 0.25, 0.3]))
        rows.append((i, f"{prose(rng, 60, 4000)} {copy} {prose(rng, 60, 4000)}"))
        if i % 2:
            rows.append((100 + i, f"{prose(rng, 30, 4000)} {item}"))
            want.add((100 + i, i))
        if slow_align(item.split(), copy.split()) >= len(item.split()):
            want.add((i, i))
    rows.append((500, " ".join(f"{x} and" for x in tests[0][1].split())))  # a word after each
    want.add((500, 0))
    assert len(want) > 80
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(table(spark, rows), items(spark, tests)).collect()}
    assert want <= found
    assert all(d % 100 == i for d, i in found - want)  # long passages


def test_long_passages_of_longer_items_are_found(spark):
    rng = random.Random(6)
    tests = [(i, prose(rng, n, 50_000)) for i, n in enumerate((59, 200, 59, 200, 2000))]
    taken = [(0, 29), (60, 150), (20, 32), (100, 130), (700, 740)]
    copies = [" ".join(t.split()[a:b]) for (_, t), (a, b) in zip(tests, taken)]
    copies[3] = " ".join(w if k % 5 else f"e{k}" for k, w in enumerate(copies[3].split()))
    rows = [(i, f"{prose(rng, 80, 50_000)} {c} {prose(rng, 80, 50_000)}") for i, c in enumerate(copies)]
    found = D.find_leaks(table(spark, rows), items(spark, tests)).collect()
    # Twelve words in a row are too few.
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (3, 3), (4, 4)}
    at = {r.doc_id: (r.from_word, r.to_word) for r in found}
    assert at[0] == (80, 109) and at[1] == (80, 170) and at[4] == (80, 120)
