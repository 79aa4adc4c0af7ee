import hashlib
import random
from collections import Counter

import pytest
from llm_helpers import AWKWARD, prose, table, words_of

from visitlake.llm import substring_dedup as S
from visitlake.llm import tables


def brute(rows, k):
    seen = Counter()
    for _, t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if seen[tuple(w[p : p + k])] > 1:
                gone.update(range(p, p + k))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def run(spark, rows, k):
    return sorted(map(tuple, S.remove_repeats(table(spark, rows), tables.stage(spark, "t"), k=k).collect()), key=repr)


@pytest.mark.parametrize("k", [3, 7, 35])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    shared = [prose(rng, rng.choice([k - 1, k, k + 9])) for _ in range(4)]
    rows = [(900 + i, t) for i, t in enumerate(AWKWARD)]
    for i in range(60):
        parts = [prose(rng, rng.randrange(1, 50), 60)]
        if rng.random() < 0.5:
            parts += [rng.choice(shared), prose(rng, 4)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    copy = prose(rng, 50)
    rows += [(70, copy), (70, copy), (71, copy), (None, copy), (None, prose(rng, 40)), (72, "x y " * 200)]
    assert run(spark, rows, k) == brute(rows, k)


def test_full_bitmaps_and_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(tables, "MARK_BITS", 64)
    monkeypatch.setattr(S, "SAMPLE_RATE", 1)
    monkeypatch.setattr(S, "SAMPLE_COUNT", 3)
    rng = random.Random(3)
    line = prose(rng, 12)
    rows = [(i, f"{prose(rng, 20)} {line} {prose(rng, 20)}") for i in range(40)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_empty_table(spark):
    assert run(spark, [], 35) == []
