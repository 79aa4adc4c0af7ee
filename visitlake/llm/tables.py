"""Reading the given tables, staging, and joins whose broadcast is checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.sources.staging import Staging

# A side with at most this many narrow rows (an id and a few numbers) is
# broadcast: some tens of megabytes on each executor. Larger ones are shuffled.
MAX_BROADCAST_ROWS = 400_000
# Bits of a bitmap of keys, which is broadcast: 8 MB at any size of the corpus.
MARK_BITS = 1 << 26


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap of fixed size of hashed keys, for ``words.is_marked``.

    It lets work skip keys that are not among these. What passes is a superset: the
    fuller the bitmap, the less is skipped, and results are the same.
    """
    at = keys.select(F.col(column).bitwiseAND(F.lit(MARK_BITS - 1)).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("bits")
    )
    found = bits.toArrow()
    marks = np.zeros(MARK_BITS // 64, np.uint64)
    marks[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return marks


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts that stay in the megabytes. For this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small(frame: DataFrame, n_rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast when the measured number of rows allows it."""
    return F.broadcast(frame) if n_rows <= limit else frame


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def stage(spark: SparkSession, label: str) -> Staging:
    """A folder of staged tables in the shared checkpoint folder. The returned
    frames of an operator may read it, so the caller keeps it."""
    return Staging(spark, label)
