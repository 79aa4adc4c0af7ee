"""Backup: source files or landed visits into the store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions import ranges
from visitlake.functions.predicates import in_range
from visitlake.operators import ingest
from visitlake.sources import detect, history_files, normalize
from visitlake.sources.staging import Staging
from visitlake.sources.store import VisitStore

# A broadcast of at most this many file names stays in the low megabytes.
MAX_BROADCAST_FILES = 10_000
# Above this many distinct days the partition filter becomes a plain range.
MAX_LISTED_DAYS = 400


@dataclass
class BackupResult:
    """Outcome of a run. ``report`` has a row per file, ``summary`` one row."""

    run_seq: int | None
    report: DataFrame
    staging: Staging | None = None
    summary: DataFrame = field(init=False)

    def __post_init__(self):
        self.summary = ingest.run_summary(self.report)

    def close(self) -> None:
        """Drop what a run without writes kept for its report."""
        if self.staging is not None:
            self.staging.drop()


def backup_files(
    store: VisitStore,
    *,
    homes: Sequence[str] = (),
    paths: Sequence[str] = (),
    as_of=None,
    dry_run: bool = False,
    preview: bool = False,
    split_bytes: int | None = None,
) -> BackupResult:
    """Back up browser history files.

    ``homes`` are (globs of) home directories in which the known profile
    locations are looked up; leave it empty to disable detection. ``paths`` are
    further files. ``dry_run`` only counts what was found; with ``preview`` it
    also counts what would be imported.
    """
    spark = store.spark
    accepted = ranges.full_range(as_of, store.zone)
    if not homes and not paths:
        raise ValueError("nothing to back up: give homes or paths")
    wanted = history_files.Wanted(accepted.start_ms, accepted.end_ms)
    staging = Staging(spark, "files")
    source = detect.read_files(spark, staging, homes, paths, wanted, split_bytes)
    if dry_run and not preview:
        rows = normalize.normalize_history(source, keep_status=True)
        return BackupResult(None, ingest.dry_run_report(rows, accepted), staging)
    with staging:
        return backup_source(store, source, as_of=as_of, dry_run=dry_run)


def backup_source(store: VisitStore, source: DataFrame, *, as_of=None, dry_run: bool = False) -> BackupResult:
    """Back up rows as the ``browser_history`` format or ``hadoop_files`` give them."""
    accepted = ranges.full_range(as_of, store.zone)
    with Staging(store.spark, "backup") as staging:
        # Staged at once: reading the files again would cost more than Parquet
        # does, and a file may be replaced while the job runs. The few status
        # rows go to a partition of their own.
        source = source.withColumn("is_status", F.col("url").isNull())
        raw, seen = staging.write_observed(source, "source", {"n_rows": F.count(F.lit(1))}, "is_status")
        files = normalize.file_status(raw.filter("is_status")).select("data_path", "error")
        found = normalize.normalize_history(without_failed_files(raw.filter("NOT is_status"), files))
        return _run(store, staging, found, files, accepted, seen["n_rows"], dry_run)


def backup_visits(
    store: VisitStore,
    found: DataFrame,
    *,
    as_of=None,
    dry_run: bool = False,
    preview: bool = False,
    stage_input: bool = True,
) -> BackupResult:
    """Back up visits that were normalised from landed tables.

    A file with a visit without url in the accepted range fails as a whole, like a
    history file would. The input is read twice. It is staged first unless ``stage_input`` is off,
    which saves a copy when it is no more than a scan of a table that stays as
    it is during the run.
    """
    accepted = ranges.full_range(as_of, store.zone)
    staged = found.select(*normalize.FOUND_COLUMNS)
    bad = F.col("url").isNull() & in_range(staged, accepted)
    if dry_run and not preview:
        rows = staged.withColumn("error", F.when(bad, F.lit(ingest.NO_URL)))
        return BackupResult(None, ingest.dry_run_report(rows, accepted))
    with Staging(store.spark, "backup") as staging:
        n_rows, any_bad = None, True
        if stage_input:
            figures = {"n_rows": F.count(F.lit(1)), "n_bad": F.count_if(bad)}
            staged, seen = staging.write_observed(staged, "source", figures)
            n_rows, any_bad = seen["n_rows"], seen["n_bad"] > 0
        files = ingest.landed_files(staged, accepted)
        if any_bad:
            staged = without_failed_files(staged, files)
        return _run(store, staging, staged, files, accepted, n_rows, dry_run)


def without_failed_files(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Drop every row of a file that failed, also those read before the failure."""
    failed = files.filter(F.col("error").isNotNull()).select("data_path")
    n_failed = failed.limit(MAX_BROADCAST_FILES + 1).count()
    if n_failed == 0:
        return raw
    if n_failed <= MAX_BROADCAST_FILES:
        failed = F.broadcast(failed)
    return raw.join(failed, "data_path", "left_anti")


def batch_days(profile: DataFrame) -> list[date]:
    """UTC days of a batch. Accepted visits lie between 1970 and tomorrow, so
    the list is bounded by the calendar."""
    return sorted(row["day"] for row in profile.select("day").distinct().collect())


def stored_on(store: VisitStore, days: list[date]) -> DataFrame:
    """The stored visits that can collide with a batch: those of its days."""
    day = F.col("visit_day")
    if len(days) > MAX_LISTED_DAYS:
        return store.visits().filter(day.between(days[0], days[-1]))
    return store.visits().filter(day.isin(days))


def _run(
    store: VisitStore,
    staging: Staging,
    found: DataFrame,
    files: DataFrame,
    accepted: ranges.TimeRange,
    n_rows: int | None,
    dry_run: bool,
) -> BackupResult:
    """``n_rows``: an upper bound of the rows, if known."""
    found = ingest.accepted_visits(found, accepted)
    profile = staging.write(ingest.profile_found(found), "profile")
    days = batch_days(profile)
    stored = stored_on(store, days)
    new = ingest.drop_stored_visits(ingest.dedup_visits(found), stored, n_rows, found, staging)
    new, n_new = staging.write_measured(new, "new", F.count(F.lit(1)))
    report = ingest.file_report(files, profile, new)
    if dry_run:
        staging.kept = True
        return BackupResult(None, report, staging)

    store.repair_rollups()
    run_seq = store.next_run_seq()
    if n_new:
        titles = ingest.resolve_titles(ingest.first_titles(new), store.url_index(), n_new)
        titles = staging.write(titles, "titles")
        store.append_urls(titles.filter("is_new"))
        note = store.note_days(days)
        store.append_visits(ingest.apply_titles(new, titles))
        store.append_rollups(new, run_seq)
        store.drop_note(note)
    store.append_runs(report.withColumn("run_seq", F.lit(run_seq).cast("bigint")))
    written = store.import_runs().filter(F.col("run_seq") == run_seq)
    return BackupResult(run_seq, written.drop("run_seq"))
