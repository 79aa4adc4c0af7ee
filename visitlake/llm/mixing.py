"""Mixing rates that bring a corpus to target shares of its domains.

A classifier learned from a labelled table gives each text a soft membership: a
probability per domain, by softmax regression on surface figures and, for the
domains named so, on hashed word features (FTRL, trained on the other half of the
sample). Rates r >= 0 per text, near 1, then solve least squares on

    sum over texts of r * tokens * P(domain | text) = target tokens of the domain

with the rates that are nearest to 1, r = max(0, 1 - memberships . multipliers).
The multipliers, a number per domain, are found by Newton steps: an iteration is
one sum over a table of a few numbers per text, and nothing else passes through
the driver. Steps end at the tolerance, or where they change the residual no more,
which is then logged: the targets cannot be met.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm import quality, toxicity, words
from visitlake.sources.staging import Staging

MAX_LABELLED = 24_000  # rows to fit on
NEWTON_STEPS, RIDGE = 8, 1e-3
TOLERANCE, DAMPING = 1e-4, 1e-9
COLUMNS = ("n_tokens", "memberships", "rate", "n_copies")


_LOG = logging.getLogger(__name__)


@dataclass
class Classifier:
    """Softmax regression on figures and the logits of the lexical domains."""

    domains: list[str]
    lexical: list[tuple[np.ndarray, np.ndarray]]  # weights by slot
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None

    def tables(self) -> list[np.ndarray]:
        out = []
        for at, w in self.lexical:
            table = np.zeros(toxicity.DIMS + 1, np.float32)
            table[at] = w
            out.append(table)
        return out

    def raw(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        columns = [quality.figures(data, offsets)]
        if tables:
            slots, row, count = toxicity.slots_of(data, offsets)
        for table in tables:
            used = np.flatnonzero(table[slots])
            pairs = np.unique(row[used] * np.int64(toxicity.DIMS) + slots[used])
            total = np.bincount(pairs // toxicity.DIMS, table[pairs % toxicity.DIMS], count) + table[-1]
            columns.append(total[:, None])
        return np.concatenate(columns, 1)

    def inputs(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((raw - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.ones((len(x), 1)), x, x[:, : quality.FIGURES] ** 2], 1)

    def memberships(self, raw: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(raw), len(self.domains)), 1.0 / len(self.domains))
        return _softmax(self.inputs(raw) @ self.weights)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _newton_sums(shared):
    def run(batches):
        model = shared.value
        k = len(model.domains)
        width = len(model.mean)
        size = k * (1 + width + quality.FIGURES)
        gradient, curvature = np.zeros(size), np.zeros((size, size))
        for b in batches:
            if not b.num_rows:
                continue
            x = model.inputs(_rows(b.column("raw"), width))
            p = _softmax(x @ model.weights)
            y = np.zeros_like(p)
            y[np.arange(len(y)), b.column("label").to_numpy().astype(int)] = 1
            gradient += (x.T @ (y - p)).T.ravel()
            n = x.shape[1]
            for i in range(k):
                for j in range(k):
                    w = p[:, i] * ((i == j) - p[:, j])
                    curvature[i * n : (i + 1) * n, j * n : (j + 1) * n] += (x * w[:, None]).T @ x
        flat = np.concatenate([gradient, curvature.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["sums"])

    return run


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], lexical: list[str], staging: Staging) -> Classifier:
    """Fit on a bounded sample of ``labelled`` (doc_id, domain). Rows with a null or
    unknown domain are left out; of several domains of one id the first listed counts."""
    spark = docs.sparkSession
    number = F.coalesce(*(F.when(F.col("domain") == d, F.lit(-i)) for i, d in enumerate(domains)))
    known = labelled.select("doc_id", number.alias("number"))
    sample = staging.write(
        toxicity.labelled_sample(docs, known, "number", F.lit(True), MAX_LABELLED).withColumn("label", -F.col("label")),
        "labelled",
    )
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    words_half, rest = sample.filter(half == 0), sample.filter(half == 1)
    weights = []
    for domain in lexical:
        own = words_half.withColumn("label", (F.col("label") == domains.index(domain)).cast("double"))
        weights.append(toxicity.train(own))
    width = quality.FIGURES + len(lexical)
    model = Classifier(domains, weights, np.zeros(width), np.ones(width))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        tables = shared.value.tables()
        for batch in batches:
            for rows, data, offsets in words.chunks(batch):
                raw = shared.value.raw(data, offsets, tables)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("label"), pa.array(list(raw), pa.list_(pa.float64()))], ["label", "raw"]
                )

    table = staging.write(rest.select("label", "text").mapInArrow(run, "label double, raw array<double>"), "raw")
    each = [F.col("raw")[i] for i in range(width)]
    facts = table.agg(F.count(F.lit(1)), *[F.mean(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    if not facts[0]:
        return model
    model.mean, model.scale = np.array(facts[1 : 1 + width]), np.maximum(np.array(facts[1 + width :]), 1e-6)
    n = 1 + width + quality.FIGURES
    model.weights = np.zeros((n, len(domains)))
    for _ in range(NEWTON_STEPS):
        parts = table.mapInArrow(_newton_sums(spark.sparkContext.broadcast(model)), "sums array<double>").collect()
        sums = np.sum([np.array(p["sums"]) for p in parts], axis=0)
        size = n * len(domains)
        flat = model.weights.T.ravel()
        gradient = sums[:size] - RIDGE * facts[0] * flat
        curvature = sums[size:].reshape(size, size) + RIDGE * facts[0] * np.eye(size)
        model.weights = (flat + np.linalg.solve(curvature, gradient)).reshape(len(domains), n).T
    return model


def _rates(memberships: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(memberships))
    for step in steps:
        rate = np.maximum(0.0, rate - memberships @ step)
    return rate


def _expected(table: DataFrame, k: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each domain that the rates after these steps give, and what they
    lose by the multiplier of each, over texts whose rate is not cut at zero."""

    def run(batches):
        total = np.zeros(k + k * k)
        for b in batches:
            if b.num_rows:
                p, n = _rows(b.column("memberships"), k), b.column("n_tokens").to_numpy()
                rate = _rates(p, steps)
                total[:k] += (rate * n) @ p
                total[k:] += (p.T @ (p * ((rate > 0) * n)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    parts = table.select("n_tokens", "memberships").mapInArrow(run, "total array<double>").collect()
    sums = np.sum([np.array(p["total"]) for p in parts], axis=0) if parts else np.zeros(k + k * k)
    return sums[:k], sums[k:].reshape(k, k)


def solve(table: DataFrame, shares: list[float]) -> list[np.ndarray]:
    """Multipliers of the rates for the target shares of all tokens; a list of one, or none.

    The sum of n * max(0, 1 - p . x)^2 / 2 + target . x is convex in the multipliers
    x and its slope is the residual, so a damped Newton step that does not lower the
    residual is halved, and the damping raised. Domains without tokens are left alone.
    """
    k = len(shares)
    x = np.zeros(k)
    now, curvature = _expected(table, k, [])
    mass, total = now, now.sum()
    if not total:
        return []
    target = np.array(shares) / sum(shares) * total
    some = mass > 1e-9 * total
    residual = np.where(some, now - target, 0.0)
    damping = DAMPING
    while np.abs(residual).max() > TOLERANCE * total and damping < 1e3:
        step = np.linalg.solve(curvature + damping * total * np.eye(k), residual)
        for _ in range(4):
            found, bent = _expected(table, k, [x + step])
            left = np.where(some, found - target, 0.0)
            if np.linalg.norm(left) < (1 - 1e-4) * np.linalg.norm(residual):
                x, residual, curvature = x + step, left, bent
                damping = max(damping / 10, DAMPING)
                break
            step = step / 2
        else:
            damping *= 100
    if np.abs(residual).max() > TOLERANCE * total:
        _LOG.warning("targets cannot be met; shares of the tokens: %s", ((residual + target) / total).tolist())
    return [x] if x.any() else []


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    staging: Staging,
    *,
    lexical: tuple[str, ...] = (),
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with n_tokens,
    memberships (probabilities in the order of ``targets``), rate and n_copies.

    ``targets`` are shares of the tokens by domain, ``labelled`` has doc_id and
    domain. n_copies is the rate, rounded up or down by a hash of id and text so
    that it is right on average. Words are split at ASCII white space; a null or
    empty text has no tokens and a rate like any other. Without labels all
    memberships are equal. Repeated rows get the same numbers. Columns of the
    four names are replaced. The result reads tables in ``staging``.
    """
    domains = list(targets)
    model = learn(docs.select("doc_id", "text"), labelled, domains, list(lexical), staging)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep or docs.columns if c not in COLUMNS]
    rows = docs.select(*kept, F.col("text").alias("__text"), F.xxhash64("doc_id", "text").alias("__turn"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches):
        model = shared.value
        tables = model.tables()
        for batch in batches:
            for part, data, offsets in words.chunks(batch, "__text"):
                p = model.memberships(model.raw(data, offsets, tables))
                counts = words.words(data, offsets).counts
                yield pa.RecordBatch.from_arrays(
                    [*part.select(kept).columns, part.column("__turn"), pa.array(counts),
                     pa.array(list(p), pa.list_(pa.float64()))],
                    [*kept, "__turn", "n_tokens", "memberships"],
                )

    schema = f"{fields}, __turn bigint, n_tokens bigint, memberships array<double>"
    table = staging.write(rows.mapInArrow(run, schema), "memberships")
    steps = solve(table, [targets[d] for d in domains])
    k = len(domains)

    def apply(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rate = _rates(_rows(b.column("memberships"), k), steps)
            part = (b.column("__turn").to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0**-53
            copies = np.floor(rate + part).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.select([*kept, "n_tokens", "memberships"]).columns, pa.array(rate), pa.array(copies)],
                [*kept, *COLUMNS],
            )

    return table.mapInArrow(apply, f"{fields}, n_tokens bigint, memberships array<double>, rate double, n_copies bigint")
