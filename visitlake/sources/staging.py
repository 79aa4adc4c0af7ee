"""Written intermediate tables in the cluster's shared folder.

A staged table cuts lineage and survives lost executors. The folder is the one
the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CONF = "spark.checkpoint.dir"
_local_defaults: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master gets a default."""
    folder = spark.conf.get(CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CONF} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_defaults:
        _local_defaults[application] = tempfile.mkdtemp(prefix="visitlake-")
    return _local_defaults[application]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


class Staging:
    """Tables staged by one job. As a context manager it removes them at the end,
    unless ``kept`` for a result that still reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = new_folder(spark, label)
        self.kept = False

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *exc) -> None:
        if not self.kept:
            self.drop()

    def write_measured(
        self, frame: DataFrame, name: str, figure: Column, *partition_by: str
    ) -> tuple[DataFrame, int]:
        """Like ``write``, also returning an aggregate that is taken on the way.

        A repeated task may be counted twice, so take it as an upper bound.
        """
        staged, seen = self.write_observed(frame, name, {"figure": figure}, *partition_by)
        return staged, seen["figure"] or 0

    def write_observed(
        self, frame: DataFrame, name: str, figures: dict[str, Column], *partition_by: str
    ) -> tuple[DataFrame, dict]:
        """The same with several aggregates by name."""
        seen = Observation(name)
        named = [figure.alias(key) for key, figure in figures.items()]
        staged = self.write(frame.observe(seen, *named), name, *partition_by)
        return staged, seen.get

    def write(self, frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def discard(self, *names: str) -> None:
        """Removes tables that nothing reads any more, and lets Spark do the same with
        shuffle files: it keeps those of a job until the driver has collected what
        referred to them, which in a long job can take until its end."""
        for name in names:
            delete_folder(self.spark, f"{self.folder}/{name}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _hadoop(spark, folder)
    fs.mkdirs(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _hadoop(spark, folder)
    fs.delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies directly in a folder."""
    fs, path = _hadoop(spark, folder)
    return [status.getPath().getName() for status in fs.listStatus(path)]


def folder_bytes(spark: SparkSession, folder: str) -> int:
    fs, path = _hadoop(spark, folder)
    return fs.getContentSummary(path).getLength()


def folder_exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _hadoop(spark, folder)
    return fs.exists(path)


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """A small file, which appears with all of its content."""
    fs, path = _hadoop(spark, file)
    part = path.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, path)


def read_text(spark: SparkSession, file: str) -> str:
    fs, path = _hadoop(spark, file)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
