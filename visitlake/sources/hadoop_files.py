"""History files that no executor has mounted, read through Hadoop's file systems.

Spark's own ``binaryFile`` source brings the bytes, from any store it can read, to the
tasks that parse them. Names and lengths are listed first without reading a byte; a file
with changes beside it is put together with these by a shuffle, all others are parsed
where they are read. SQLite takes a file's bytes as a database in memory; only one with
changes goes through the task's scratch folder, as sorting these out writes.

A file is one row here, so it is held whole by its task and cannot be cut: files of more
than ``MOST_BYTES`` are reported as failed. Spark lists what a pattern names; hidden
folders below ``homes`` are found as the known locations name them.
"""

from __future__ import annotations

import os
import sqlite3
import sys
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake import schema
from visitlake.sources import history_files, profiles
from visitlake.sources.history_files import SIDECARS, FileSlice, Wanted
from visitlake.sources.staging import Staging

# What Spark can hold in a row, with some room.
MOST_BYTES = (1 << 31) - (1 << 20)
# Some ten megabytes of names.
MAX_BROADCAST_NAMES = 100_000
# Contents go to Python in batches of about this size, or one file.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
_TOO_LARGE = f"ValueError: a file of more than {MOST_BYTES} bytes"
# The bytes of SQLite's header that say how changes are logged.
_LOGGING, _WITHOUT_LOG = slice(18, 20), b"\x01\x01"
_ENDING = "(" + "|".join(SIDECARS) + ")$"


def _pattern(names: Sequence[str]) -> str:
    return "{" + ",".join(name + ending for name in names for ending in ("", *SIDECARS)) + "}"


def _files(spark: SparkSession, homes: Sequence[str], paths: Sequence[str]) -> DataFrame:
    known = _pattern([pattern for _, _, pattern in profiles.PROFILE_PATTERNS])
    found = []
    for place in [f"{home.rstrip('/')}/{known}" for home in homes] + [path + _pattern([""]) for path in paths]:
        try:
            found.append(spark.read.format("binaryFile").load(place))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if not found:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _memory(content: bytes) -> sqlite3.Connection:
    """A database in memory. It cannot have a log, and this one's is empty."""
    raw = bytearray(content)
    if raw[_LOGGING] == b"\x02\x02":
        raw[_LOGGING] = _WITHOUT_LOG
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(raw))
    return db


def _read_plain(batches: Iterator[pa.RecordBatch], wanted: Wanted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            path, seq, content = (batch.column(i)[row].as_py() for i in range(3))
            part = FileSlice(path, seq, 0, 1)

            def rows(part=part, content=content):
                yield from history_files.read_open(_memory(content), part, wanted)

            yield from history_files.rows_and_status(part, rows())


def _read_changed(batches: Iterator[pa.RecordBatch], wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """data_path, file_seq, parts: array of (ending, content)."""
    for batch in batches:
        for row in range(batch.num_rows):
            path, seq, parts = (batch.column(i)[row].as_py() for i in range(3))
            part = FileSlice(path, seq, 0, 1)
            with tempfile.TemporaryDirectory(prefix="history-") as scratch:  # this task's own, gone at once
                for piece in parts:
                    with open(os.path.join(scratch, "copy" + piece["ending"]), "wb") as out:
                        out.write(piece["content"])

                def rows(part=part, scratch=scratch):
                    db = sqlite3.connect(f"file:{scratch}/copy?mode=rw", uri=True)
                    yield from history_files.read_open(db, part, wanted)

                yield from history_files.rows_and_status(part, rows())


def _fit(names: DataFrame, n: int) -> DataFrame:
    return F.broadcast(names) if n <= MAX_BROADCAST_NAMES else names


def read_landing(
    spark: SparkSession,
    staging: Staging,
    homes: Sequence[str] = (),
    paths: Sequence[str] = (),
    wanted: Wanted = Wanted(),
) -> DataFrame:
    """Rows like those of the ``browser_history`` format. ``homes`` and ``paths`` are
    URIs, or patterns of some, of any file system that Spark reads. Where the session
    does not bound the bytes of an Arrow batch, it does from now on."""
    history_files.register(spark)
    if BATCH_BYTES[0] not in {row["key"] for row in spark.sql("SET").collect()}:
        spark.conf.set(*BATCH_BYTES)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files = _files(spark, homes, paths).select(
        F.regexp_replace("path", _ENDING, "").alias("data_path"), F.regexp_extract("path", _ENDING, 1).alias("ending"),
        "length", "content",
    )
    main, beside = F.col("ending") == "", (F.col("ending") != "") & (F.col("length") > 0)
    named = files.filter(main | beside).groupBy("data_path").agg(
        F.max(main).alias("there"), F.max(beside).alias("changed"), F.max("length").alias("most")
    )
    named = named.filter("there").orderBy("data_path").withColumn("file_seq", F.monotonically_increasing_id())
    named, seen = staging.write_observed(
        named, "names", {"n": F.count(F.lit(1)), "n_changed": F.count_if("changed")}
    )

    def of(which: str, n: int) -> DataFrame:
        fitting = named.filter(which).filter(F.col("most") <= MOST_BYTES)
        # The bound on the file itself reaches the source, which reads no longer one.
        return files.filter(F.col("length") <= MOST_BYTES).join(_fit(fitting.select("data_path", "file_seq"), n), "data_path")

    plain = of("NOT changed", seen["n"]).filter(main).select("data_path", "file_seq", "content")
    rows = plain.mapInArrow(lambda batches: _read_plain(batches, wanted), schema.SOURCE_ROWS)
    if seen["n_changed"]:
        parts = of("changed", seen["n_changed"]).filter(main | beside)
        parts = parts.groupBy("data_path", "file_seq").agg(F.collect_list(F.struct("ending", "content")).alias("parts"))
        rows = rows.unionByName(parts.mapInArrow(lambda batches: _read_changed(batches, wanted), schema.SOURCE_ROWS))
    large = named.filter(F.col("most") > MOST_BYTES)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.SOURCE_ROWS if f.name not in ("data_path", "file_seq", "error")]
    failed = large.select("data_path", "file_seq", F.lit(_TOO_LARGE).alias("error"), *blank)
    return rows.unionByName(failed.select(*schema.SOURCE_ROWS.names))
