"""Quality scores: Bradley-Terry ranking learned from preference pairs.

Each text gets a fixed number of surface figures. A labelled good text is
preferred to a labelled bad one; pairs are drawn by a join on hashed buckets.
Their logistic loss on differences of figures is minimised by Newton steps whose
sums are taken in Spark, so the driver sees one small matrix per task and step.
A document's score is the sum of its weighted figures; the threshold is the
quantile of the labelled texts' scores that matches their share of bad ones, and maps
to a probability given by the caller. All labelled texts that may be learned from count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm import words
from visitlake.llm.toxicity import labelled_sample
from visitlake.sources.staging import Staging

DRAWS = 6  # pairs per bad text
STEPS = 8
RIDGE = 1e-3

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_STOP = np.isin(_B, list(b".!?"))
_MARKS = [np.isin(_B, list(group)) for group in (b"!", b"|", b"#&%$@*^~<>{}[]\\/=+_", b".,;:", b"\"'()-", b"\n")]
FIGURES = 8 + len(_MARKS) + 6


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 256: how often each row has each byte."""
    row = np.repeat(np.arange(0, 256 * (len(offsets) - 1), 256), np.diff(offsets))
    return np.bincount(row + data, minlength=256 * (len(offsets) - 1)).reshape(-1, 256)


def _line_repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of lines that repeat an earlier line of the row."""
    separators = np.zeros(256, bool)
    separators[0x0A] = True
    lines = words.words(data, offsets, separators)
    pairs = np.stack([lines.row_of().astype(np.uint64), lines.hashes()], 1)
    kinds = np.unique(pairs, axis=0) if len(pairs) < 2 else np.unique(pairs.view("u8,u8").ravel()).view("u8").reshape(-1, 2)
    distinct = np.bincount(kinds[:, 0].astype(np.int64), minlength=lines.rows)
    return (lines.counts - distinct) / np.maximum(lines.counts, 1)


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FIGURES; all zero for an empty text."""
    w = words.words(data, offsets, lower=True)
    n_bytes = np.maximum(np.diff(offsets), 1)
    n = w.counts
    n_words = np.maximum(n, 1)
    counts = _byte_counts(data, offsets)
    letters = np.maximum(counts @ (_UPPER | _LOWER), 1)
    h = w.hashes()
    row = w.row_of()
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0)
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(h)))
    owner = row[order][begin]
    most = np.zeros(w.rows, np.int64)
    np.maximum.at(most, owner, sizes)
    distinct = np.bincount(owner, minlength=w.rows)
    length = w.ends - w.starts
    mean = np.bincount(row, length, w.rows) / n_words
    squares = np.bincount(row, length.astype(float) ** 2, w.rows) / n_words
    ends = counts @ _STOP
    columns = [
        np.log1p(n),
        counts @ _UPPER / letters,
        counts @ _DIGIT / n_bytes,
        counts @ (_B >= 128) / n_bytes,
        mean,
        np.sqrt(np.maximum(squares - mean**2, 0)),
        np.log1p(n / np.maximum(ends, 1)),
        np.bincount(row, length <= 3, w.rows) / n_words,
    ]
    columns += [np.sqrt(counts @ flags / n_words) for flags in _MARKS]
    columns += [
        distinct / n_words,
        most / n_words,
        _line_repeats(data, offsets),
        np.bincount(row, length >= 20, w.rows) / n_words,
        (n > 0) & (n < 5),
        np.log1p(distinct),
    ]
    return np.stack([np.asarray(c, float) for c in columns], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def inputs(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((raw - self.mean) / self.scale, -5, 5)
        return np.concatenate([x, x * x], 1)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return self.inputs(raw) @ self.weights


def _figure_rows(rows: DataFrame, keep: list[str], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, data, offsets in words.chunks(batch):
                f = figures(data, offsets)
                kept = part.select(keep)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(list(f), pa.list_(pa.float64()))], [*keep, "figures"]
                )

    return rows.select(*keep, "text").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FIGURES)


def _newton_sums(shared):
    def run(batches):
        model = shared.value
        size = 2 * FIGURES
        gradient, curvature = np.zeros(size), np.zeros((size, size))
        for b in batches:
            if not b.num_rows:
                continue
            x = model.inputs(_matrix(b.column("good"))) - model.inputs(_matrix(b.column("bad")))
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -35, 35)))
            gradient += x.T @ (1 - p)
            curvature += (x * (p * (1 - p))[:, None]).T @ x
        flat = np.concatenate([gradient, curvature.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["sums"])

    return run


def train(sample: DataFrame, staging: Staging) -> Model | None:
    """Fit on rows of doc_id, text, label (1 is good). None unless both labels occur."""
    spark = sample.sparkSession
    rows = staging.write(
        _figure_rows(sample, ["doc_id", "label"], "doc_id bigint, label double, figures array<double>"), "figures"
    )
    each = [F.col("figures")[i] for i in range(FIGURES)]
    facts = rows.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0),
        *[F.mean(x) for x in each], *[F.stddev_pop(x) for x in each],
    ).first()
    n_good, n_bad = facts[0], facts[1]
    if not n_good or not n_bad:
        return None
    mean = np.array(facts[2 : 2 + FIGURES])
    scale = np.maximum(np.array(facts[2 + FIGURES :]), 1e-6)
    model = Model(mean, scale, np.zeros(2 * FIGURES), 0.0)
    # About one good text per bucket; each bad one draws a few buckets.
    good = rows.filter("label = 1").select(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(n_good)).alias("bucket"), F.col("figures").alias("good")
    )
    bad = rows.filter("label = 0").select(
        F.col("doc_id"), F.col("figures").alias("bad"), F.explode(F.sequence(F.lit(1), F.lit(DRAWS))).alias("draw")
    )
    bad = bad.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "draw"), F.lit(n_good)))
    pairs = staging.write(good.join(bad, "bucket").select("good", "bad"), "pairs")
    n_pairs = pairs.count()
    for _ in range(STEPS if n_pairs else 0):
        shared = spark.sparkContext.broadcast(model)
        parts = pairs.mapInArrow(_newton_sums(shared), "sums array<double>").collect()
        sums = np.sum([np.array(p["sums"]) for p in parts], axis=0)
        size = 2 * FIGURES
        gradient = sums[:size] - RIDGE * n_pairs * model.weights
        curvature = sums[size:].reshape(size, size) + RIDGE * n_pairs * np.eye(size)
        model.weights = model.weights + np.linalg.solve(curvature, gradient)
    scored = _scored(rows.select("doc_id", "figures"), model)
    share = n_bad / (n_good + n_bad)
    model.threshold = scored.approxQuantile("raw", [share], 0.001)[0]
    return model


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                scores = shared.value.scores(_matrix(b.column("figures")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "raw"])

    return rows.mapInArrow(run, "doc_id bigint, raw double")


def quality(
    docs: DataFrame, labels: DataFrame, usable, staging: Staging, *, column: str = "quality", threshold: float = 0.5
) -> DataFrame:
    """A row per row of ``docs``: doc_id, raw score, and score from 0 to 1.

    A score of at least ``threshold`` means that the raw score is at or over the
    quantile of the labelled texts that parts the bad ones from the good ones.
    ``usable`` is a condition on doc_id for the rows to learn from. A null text
    counts as an empty one, whose figures are zero. Without labels of both kinds
    every score is ``threshold``. Other columns are ignored.
    """
    model = train(labelled_sample(docs, labels, column, usable), staging)
    if model is None:
        return docs.select(F.col("doc_id").cast("bigint"), F.lit(0.0).alias("raw"), F.lit(threshold).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shift = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        for batch in batches:
            for part, data, offsets in words.chunks(batch):
                raw = shared.value.scores(figures(data, offsets))
                over = raw - shared.value.threshold
                # At the threshold itself rounding must not decide.
                p = np.where(over >= 0, np.maximum(threshold, 1 / (1 + np.exp(-np.clip(over + shift, -35, 35)))),
                             1 / (1 + np.exp(-np.clip(over + shift, -35, 35))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(raw), pa.array(p)], ["doc_id", "raw", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, raw double, score double")
