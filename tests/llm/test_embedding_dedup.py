import numpy as np
import pytest

from visitlake.llm import embedding_dedup as E
from visitlake.llm import tables

SCHEMA = "vec_id long, embedding array<float>, label int, vertex string, u string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def run(spark, rows):
    found = E.near_duplicates(frame(spark, rows), tables.stage(spark, "t")).collect()
    assert len(found) == len(rows)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr)


def brute(rows, least=0.93):
    def usable(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [r for r in rows if usable(r)]
    x = [np.array(r[1], np.float32).astype(float) for r in good]
    leader = list(range(len(good)))
    n = [0] * len(good)

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            if good[i][2] == good[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= least:
                    n[i] += 1
                    n[j] += 1
                    a, b = find(i), find(j)
                    leader[max(a, b, key=lambda k: good[k][0])] = min(a, b, key=lambda k: good[k][0])
    out = [(r[0], n[i], good[find(i)][0], r[0] == good[find(i)][0]) for i, r in enumerate(good)]
    out += [(r[0], 0, r[0], r[0] is not None) for r in rows if not usable(r)]
    return sorted(out, key=repr)


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    z -= z @ v * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def vectors(rng, n=120, d=32):
    base = [rng.standard_normal(d) for _ in range(n)]
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(n + i, near(rng, base[i], rng.uniform(0.95, 0.999)), i % 3) for i in range(n // 2)]
    rows += [(2 * n + i, near(rng, base[i], rng.uniform(0.8, 0.92)), i % 3) for i in range(n // 4)]
    rows += [(3 * n + i, near(rng, base[i], 0.99), (i + 1) % 3) for i in range(9)]
    return [(i, [float(x) for x in np.float32(v)], lab) for i, v, lab in rows]


def test_links_equal_brute_force_and_awkward_rows(spark):
    rows = vectors(np.random.default_rng(1))
    v = rows[0][1]
    rows += [(5000, v, None), (5001, None, 0), (5002, [], 0), (5003, [0.0] * 32, 0), (5004, [None, *v[1:]], 0)]
    rows += [(5005, [float("nan"), *v[1:]], 0), (5006, [float("inf"), *v[1:]], 0), (None, v, 0), (5007, v[:5], 0)]
    rows += [rows[4], (5008, [2 * x for x in v], 0), (5009, [-0.0, *v[1:]], 0), (5010, [0.0, *v[1:]], 0)]
    assert run(spark, rows) == brute(rows)


def test_group_of_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = vectors(rng, 40)
    v = np.array(rows[0][1])
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)]
    rows += [(2000 + i, [float(x) for x in np.float32(near(rng, v, 0.995))], 0) for i in range(60)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("radius,rotations", [(0, E.ROTATIONS), (1, 3)])
def test_recall_just_over_the_threshold(spark, monkeypatch, radius, rotations):
    monkeypatch.setattr(E, "RADIUS", radius)
    monkeypatch.setattr(E, "ROTATIONS", rotations)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 64))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(600 + i, [float(x) for x in near(rng, v, rng.uniform(0.932, 0.94))], 0) for i, v in enumerate(base)]
    found = E.near_duplicates(frame(spark, rows), tables.stage(spark, "t")).collect()
    assert sum(r.n_links for r in found) >= 0.9 * 1200


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("d,shift", [(16, 0), (24, 0), (31, 0), (64, 1.46), (64, 1.94), (64, 2.85), (24, 2.0)])
def test_recall_with_few_dimensions_or_a_common_component(spark, d, shift):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((500, d))
    base = base / np.linalg.norm(base, axis=1)[:, None] + shift * np.eye(d)[0]
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(base)]
    rows += [(500 + i, [float(x) for x in near(rng, v, rng.uniform(0.932, 0.94))], i) for i, v in enumerate(base)]
    found = E.near_duplicates(frame(spark, rows), tables.stage(spark, "t")).collect()
    assert sum(r.n_links for r in found) >= 0.95 * 1000
