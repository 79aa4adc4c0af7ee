"""Incremental backups: a stream of arrivals, one backup run per micro-batch.

Dedup is against the store, so the stream needs neither state nor watermark, and
a micro-batch that is replayed after a failure imports nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlake.plans.backup import BackupResult, backup_files, backup_source, backup_visits
from visitlake.sources import history_files
from visitlake.sources.history_files import local_path
from visitlake.sources.store import VisitStore
from visitlake.streaming.progress import Progress, follow, observed

# Columns of Spark's binaryFile format.
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# File names browsers give their history, as a Hadoop glob.
HISTORY_FILE_NAMES = "{History,places.sqlite,History.db}"


# A file that fails again and again waits for more and more runs, up to so many.
MOST_RUNS_BETWEEN = 64


def failed_files(store: VisitStore, below: str = "/", before_run: int | None = None) -> DataFrame:
    """data_path and last_run of files whose latest import failed.

    With ``before_run``, the number of the next run, only those whose turn it is: after a
    second failure a file waits two runs, then four, and so on. None is ever given up.
    """
    runs = store.import_runs().filter(F.col("data_path").startswith(below))
    latest = runs.groupBy("data_path").agg(
        F.max_by(F.col("error").isNotNull(), "run_seq").alias("failed"),
        F.count_if(F.col("error").isNotNull()).alias("attempts"),
        F.max("run_seq").alias("last_run"),
    )
    found = latest.filter("failed")
    if before_run is not None:
        pause = F.least(F.pow(F.lit(2), F.col("attempts") - 1), F.lit(MOST_RUNS_BETWEEN))
        found = found.filter(F.lit(before_run) - F.col("last_run") >= pause)
    return found.select("data_path", "last_run")


def backup_failed(store: VisitStore, below: str = "/", *, as_of=None, max_files: int = 5_000):
    """Try again the files whose latest import failed, those that have waited longest
    first; None when there are none."""
    waiting = failed_files(store, below).orderBy("last_run", "data_path").limit(max_files)
    paths = [row["data_path"] for row in waiting.collect()]
    return backup_files(store, paths=paths, as_of=as_of) if paths else None


def _start(stream: DataFrame, run_batch, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if interval is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def backup_visit_stream(
    store: VisitStore,
    found: DataFrame,
    checkpoint: str,
    *,
    as_of=None,
    interval: str | None = None,
    progress: Progress | None = None,
) -> StreamingQuery:
    """Back up a stream of normalised visits.

    Without ``interval`` the query takes what is there and ends. ``progress`` is told
    what each micro-batch has found and imported.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        _tell(progress, batch_id, backup_visits(VisitStore(batch.sparkSession, store.path), batch, as_of=as_of))

    rows = found if progress is None else observed(found, F.lit(True))
    return _followed(store, progress, _start(rows, run_batch, checkpoint, interval))


def _tell(progress: Progress | None, batch_id: int, result: BackupResult) -> None:
    if progress is not None:
        counts = result.summary.first()
        progress.add(f"stored {batch_id}", imported=counts["imported"], failed=counts["failed"])


def _followed(store: VisitStore, progress: Progress | None, query: StreamingQuery) -> StreamingQuery:
    return query if progress is None else follow(store.spark, progress, query)


def backup_history_stream(
    store: VisitStore,
    landing: str,
    checkpoint: str,
    *,
    as_of=None,
    settle_ms: int = history_files.SETTLE_MS,
    interval: str | None = None,
    progress: Progress | None = None,
) -> StreamingQuery:
    """Back up history files as they land or change anywhere below a mounted folder.

    The stream reads the files itself, hidden ones too, and a file comes again when it
    changes: one that was still being copied is taken when it is whole, however often it
    failed before.
    """
    history_files.register(store.spark)
    options = {"landing": local_path(landing), "settle_ms": settle_ms}
    rows = store.spark.readStream.format(history_files.FORMAT).options(**options).load()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        _tell(progress, batch_id, backup_source(VisitStore(batch.sparkSession, store.path), batch, as_of=as_of))

    if progress is not None:
        is_visit = F.col("url").isNotNull()
        rows = observed(rows, is_visit, ~is_visit)
    return _followed(store, progress, _start(rows, run_batch, checkpoint, interval))


def backup_file_stream(
    store: VisitStore,
    landing: str,
    checkpoint: str,
    *,
    as_of=None,
    file_names: str = HISTORY_FILE_NAMES,
    max_files: int = 5_000,
    interval: str | None = None,
) -> StreamingQuery:
    """Back up history files as they land below a folder.

    Each snapshot needs a path of its own, as a path is taken once. Like all file
    sources of Spark the stream skips hidden folders and files. The stream
    only carries file names, at most ``max_files`` per micro-batch; the files
    are opened by the tasks of the backup. Files that failed, for example as they
    were still being copied, are tried again at the start and with later
    micro-batches, at growing distances. ``backup_history_stream`` needs no such retries.
    """
    below = local_path(landing).rstrip("/") + "/"
    backup_failed(store, below, as_of=as_of, max_files=max_files)
    arrivals = (
        store.spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_names)
        .option("maxFilesPerTrigger", max_files)
        .load(landing)
        .select("path")
    )

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        own = VisitStore(batch.sparkSession, store.path)
        paths = {local_path(row["path"]) for row in batch.collect()}
        if not paths:
            return
        waiting = failed_files(own, below, own.next_run_seq()).orderBy("last_run", "data_path").limit(max_files)
        paths.update(row["data_path"] for row in waiting.collect())
        backup_files(own, paths=sorted(paths), as_of=as_of)

    return _start(arrivals, run_batch, checkpoint, interval)
