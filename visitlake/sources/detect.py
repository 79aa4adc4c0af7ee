"""Which history files there are, found by tasks, and how they are dealt to readers."""

from __future__ import annotations

import glob
import os
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake import schema
from visitlake.sources import history_files, profiles
from visitlake.sources.history_files import DEFAULT_SPLIT_BYTES, OPEN_COST_BYTES, SIDECARS, FileSlice, Wanted
from visitlake.sources.staging import Staging

HOMES_PER_TASK = 200
_LISTED = "source int, home string, place int, data_path string, size_bytes bigint"


def _size(path: str) -> int:
    """Bytes of a file and of changes that lie beside it; 0 if it is not there."""
    total = 0
    for ending in ("", *SIDECARS):
        try:
            total += os.path.getsize(path + ending)
        except OSError:
            continue
    return total


def _matches(pattern: str) -> list[str]:
    return sorted(glob.glob(pattern, include_hidden=True))


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Patterns of homes to homes."""
    for batch in batches:
        for source, pattern in zip(batch["source"], batch["pattern"]):
            homes = _matches(pattern)
            yield pd.DataFrame({"source": [source] * len(homes), "home": homes}).astype({"source": "int32", "home": "object"})


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Homes to the files at the known locations below them."""
    patterns = [pattern for _, _, pattern in profiles.PROFILE_PATTERNS]
    for batch in batches:
        rows = [
            (source, home, place, path, _size(path))
            for source, home in zip(batch["source"], batch["home"])
            for place, pattern in enumerate(patterns)
            for path in _matches(os.path.join(glob.escape(home), pattern))
        ]
        yield pd.DataFrame(rows, columns=["source", "home", "place", "data_path", "size_bytes"])


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Named paths, or patterns of some. One that does not exist is kept: reading it
    reports the failure."""
    for batch in batches:
        rows = []
        for source, path in zip(batch["source"], batch["pattern"]):
            many = glob.has_magic(path) and not os.path.exists(path)
            rows += [(source, "", i, found, _size(found)) for i, found in enumerate(_matches(path) if many else [path])]
        yield pd.DataFrame(rows, columns=["source", "home", "place", "data_path", "size_bytes"])


def _patterns(spark: SparkSession, patterns: Sequence[str], first: int) -> DataFrame:
    rows = [(first + i, pattern) for i, pattern in enumerate(patterns)]
    return spark.createDataFrame(rows, "source int, pattern string").repartition(max(1, len(rows) // HOMES_PER_TASK))


def listed_files(spark: SparkSession, homes: Sequence[str], paths: Sequence[str], staging: Staging) -> DataFrame:
    """source, home, place, data_path, size_bytes of the files below home directories and
    of the named ones, each file once. The first three give the order of files.

    Tasks open the folders; the driver sees the patterns only.
    """
    history_files.register(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    found = _patterns(spark, homes, 0).mapInPandas(_expand, "source int, home string")
    found = found.groupBy("home").agg(F.min("source").alias("source"))
    found, n_homes = staging.write_measured(found, "homes", F.count(F.lit(1)))
    spread = found.repartition(max(1, -(-n_homes // HOMES_PER_TASK)))
    files = spread.select("source", "home").mapInPandas(_look_up, _LISTED)
    if paths:
        files = files.unionByName(_patterns(spark, paths, len(homes)).mapInPandas(_named, _LISTED))
    order = F.struct("source", "home", "place", "size_bytes")
    once = files.groupBy("data_path").agg(F.min(order).alias("first"))
    return once.select("first.source", "first.home", "first.place", "data_path", "first.size_bytes")


def planned_slices(files: DataFrame, split_bytes: int, staging: Staging) -> tuple[DataFrame, int]:
    """data_path, file_seq, k, n of the slices to read, and the number of tasks that
    makes each read about ``split_bytes``. Big files are cut, small ones share a task."""
    ordered = files.orderBy("source", "home", "place", "data_path")
    n = F.greatest(F.ceil(F.col("size_bytes") / split_bytes), F.lit(1)).cast("int")
    rows = ordered.select("data_path", F.monotonically_increasing_id().alias("file_seq"), "size_bytes", n.alias("n"))
    figures = {"cost": F.sum(F.col("size_bytes") + F.col("n") * OPEN_COST_BYTES), "n": F.sum("n")}
    rows, seen = staging.write_observed(rows, "files", figures)
    slices = rows.select("data_path", "file_seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "n")
    return slices, max(1, min(seen["n"] or 0, -(-(seen["cost"] or 0) // split_bytes)))


def read_files(
    spark: SparkSession,
    staging: Staging,
    homes: Sequence[str] = (),
    paths: Sequence[str] = (),
    wanted: Wanted = Wanted(),
    split_bytes: int | None = None,
) -> DataFrame:
    """Rows like those of the ``browser_history`` format, with the files found by tasks."""
    files = listed_files(spark, homes, paths, staging)
    slices, n_tasks = planned_slices(files, split_bytes or DEFAULT_SPLIT_BYTES, staging)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [FileSlice(r["data_path"], r["file_seq"], r["k"], r["n"]) for r in batch.to_pylist()]
            yield from history_files.read_slices(parts, wanted)

    return slices.repartition(n_tasks).mapInArrow(read, schema.SOURCE_ROWS)


def list_history_files(spark: SparkSession, homes: Sequence[str]) -> DataFrame:
    """data_path, size_bytes, product, packaging of the files below home directories.

    The size includes changes that lie beside a file.
    """
    files = listed_files(spark, homes, (), Staging(spark, "listing"))
    return files.select(
        "data_path",
        "size_bytes",
        profiles.product_of(F.col("data_path")).alias("product"),
        profiles.packaging_of(F.col("data_path")).alias("packaging"),
    )
