import random

import numpy as np
import pytest
from llm_helpers import AWKWARD, table
from test_classifiers import corpus

from visitlake.llm import mixing as M
from visitlake.llm import tables

TARGETS = {"toxic": 0.1, "low": 0.1, "clean": 0.8}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    rows, toxic, good = corpus(rng, 500)
    domain = {i: "toxic" if toxic[i] else "clean" if good[i] else "low" for i in toxic}
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "scum"), rows[3]]
    labels = spark.createDataFrame(
        [(i, d) for i, d in domain.items() if i % 3] + [(None, "low"), (1, None), (2, "other")],
        "doc_id long, domain string",
    )
    return table(spark, rows), labels, rows, domain


def test_expected_tokens_meet_the_targets(spark, data):
    docs, labels, rows, domain = data
    found = M.mix(docs, labels, TARGETS, tables.stage(spark, "t"), lexical=("toxic",))
    assert set(docs.columns) - {"rate"} < set(found.columns)
    got = found.collect()
    assert len(got) == len(rows)
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    p = np.array([r.memberships for r in got])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert [r.n_tokens for r in got if r.doc_id == 1000] == [0]
    assert np.allclose((n * rate) @ p / n.sum(), list(TARGETS.values()), atol=0.01)
    names = list(TARGETS)
    known = [(names[int(np.argmax(r.memberships))], domain[r.doc_id]) for r in got if domain.get(r.doc_id) and r.doc_id % 3 == 0]
    assert np.mean([a == b for a, b in known]) > 0.9
    copies = np.array([r.n_copies for r in got])
    assert (np.abs(copies - rate) < 1).all() and abs((copies * n).sum() / (rate * n).sum() - 1) < 0.1
    assert len({(r.rate, r.n_copies) for r in got if r.doc_id == 3}) == 1


def test_descent_finds_the_least_squares_solution(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.6, 2], 400)
    n = rng.integers(1, 500, 400)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p)]
    frame = spark.createDataFrame(rows, "n_tokens long, memberships array<double>")
    shares = [0.3, 0.3, 0.4]
    rate = M._rates(p, M.solve(frame, shares))
    assert np.allclose((n * rate) @ p / n.sum(), shares, atol=2e-4) and (rate >= 0).all()
    assert M.solve(frame.limit(0), shares) == []


def test_without_labels_or_rows(spark, data):
    docs, labels, rows, _ = data
    got = M.mix(docs, labels.limit(0), TARGETS, tables.stage(spark, "t"), keep=["doc_id"])
    assert got.columns == ["doc_id", *M.COLUMNS]
    assert {tuple(round(x, 6) for x in r.memberships) for r in got.collect()} == {(0.333333,) * 3}
    assert M.mix(table(spark, []), labels, TARGETS, tables.stage(spark, "t")).count() == 0


@pytest.mark.parametrize("concentration", [3, 10])
def test_targets_are_met_with_soft_memberships(spark, concentration):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(concentration * np.array([0.1, 0.3, 0.6]), 5000)
    n = rng.integers(1, 500, 5000)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p)]
    frame = spark.createDataFrame(rows, "n_tokens long, memberships array<double>")
    shares = [0.02, 0.08, 0.9]
    rate = M._rates(p, M.solve(frame, shares))
    assert np.abs((n * rate) @ p / n.sum() - shares).max() < 1.1e-4 and (rate >= 0).all()


def test_targets_out_of_reach_are_told(spark, caplog):
    frame = spark.createDataFrame([(10, [0.4, 0.6])] * 5, "n_tokens long, memberships array<double>")
    rate = M._rates(np.array([[0.4, 0.6]]), M.solve(frame, [0.9, 0.1]))
    assert np.isfinite(rate).all() and "cannot be met" in caplog.text
