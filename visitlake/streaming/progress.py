"""What a run has done so far, for a status page to read while it goes on.

A backup tells its steps, each with the figures that Spark has observed on the way; a
stream also tells each micro-batch through a listener, with the figures of its own query
plan and the rates of ``lastProgress``. A ``Progress`` keeps the latest of these and
totals, whose size does not grow with the run.
"""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

KEPT_STEPS = 1_000
OBSERVED = "visitlake_progress"
STEPS = "run string, step string, files bigint, found bigint, imported bigint, failed bigint, rows_per_second double"
_COUNTS = ("files", "found", "imported", "failed")


class Progress:
    """Steps of one backup or stream, and their totals. Safe to read from any thread."""

    def __init__(self, name: str = "backup"):
        self.name = name
        self._lock = threading.Lock()
        self._steps: deque[tuple] = deque(maxlen=KEPT_STEPS)
        self._totals = dict.fromkeys(_COUNTS, 0)
        self._ended = False

    def add(self, step: str, *, rate: float | None = None, **counts: int) -> None:
        """A step and what it adds to the totals."""
        with self._lock:
            for name, n in counts.items():
                self._totals[name] += n
            self._steps.append((self.name, step, *(counts.get(c) for c in _COUNTS), rate))

    def end(self) -> None:
        with self._lock:
            self._ended = True

    @property
    def totals(self) -> dict[str, int]:
        with self._lock:
            return dict(self._totals)

    @property
    def ended(self) -> bool:
        return self._ended

    def steps(self, spark: SparkSession) -> DataFrame:
        """The latest steps, oldest first."""
        with self._lock:
            rows = list(self._steps)
        return spark.createDataFrame(rows, STEPS)

    def status(self, spark: SparkSession) -> DataFrame:
        """One row: run, totals so far, and whether the run has ended."""
        with self._lock:
            row = (self.name, *(self._totals[c] for c in _COUNTS), self._ended)
        counts = ", ".join(f"{c} bigint" for c in _COUNTS)
        return spark.createDataFrame([row], f"run string, {counts}, ended boolean")


def observed(rows: DataFrame, found: Column, files: Column | None = None) -> DataFrame:
    """A stream's rows, telling its listener how many of them are visits and files."""
    counts = [F.count_if(found).alias("found")]
    if files is not None:
        counts.append(F.count_if(files).alias("files"))
    return rows.observe(OBSERVED, *counts)


class _Listener(StreamingQueryListener):
    """Tells a ``Progress`` about the micro-batches of one query."""

    def __init__(self, spark: SparkSession, progress: Progress):
        self.spark, self.progress, self.query_id = spark, progress, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        batch = event.progress
        if str(batch.id) != self.query_id or not batch.numInputRows:
            return
        figures = (batch.observedMetrics or {}).get(OBSERVED)
        counts = figures.asDict() if figures is not None else {}
        self.progress.add(
            f"batch {batch.batchId}", rate=batch.processedRowsPerSecond, **{k: v or 0 for k, v in counts.items()}
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.progress.end()
            # From another thread, as Spark's bus waits for this call.
            threading.Thread(target=self.spark.streams.removeListener, args=(self,), daemon=True).start()


def follow(spark: SparkSession, progress: Progress, query: StreamingQuery) -> StreamingQuery:
    """Reports the micro-batches of a query that has just been started."""
    listener = _Listener(spark, progress)
    listener.query_id = str(query.id)
    spark.streams.addListener(listener)
    return query
