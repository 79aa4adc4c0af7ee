"""User-facing API: one object over a store, with day strings as arguments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlake.functions import ranges
from visitlake.operators import aggregates, ingest, paging, rollups, search, toplists
from visitlake.plans.backup import BackupResult, backup_files, backup_source, backup_visits
from visitlake.plans.compaction import compact
from visitlake.plans.dashboard import Dashboard, dashboard
from visitlake.sources.detect import list_history_files
from visitlake.sources.export import export_csv
from visitlake.sources.hadoop_files import read_landing
from visitlake.sources.staging import Staging
from visitlake.sources.store import VisitStore
from visitlake.streaming.incremental import backup_file_stream, backup_history_stream, backup_visit_stream


class History:
    """Queries over a store. ``as_of`` pins "today"; ``compat`` reproduces the
    counting quirks that are corrected by default."""

    def __init__(self, store: VisitStore, *, as_of=None, compat: bool = False):
        self.store = store
        self.as_of = as_of
        self.compat = compat

    def _range(self, start: str | None, end: str | None) -> ranges.TimeRange:
        return ranges.resolve_range(start, end, self.as_of, self.store.zone)

    def backup(self, **options) -> BackupResult:
        return backup_files(self.store, as_of=self.as_of, **options)

    def backup_landed(self, found: DataFrame, **options) -> BackupResult:
        """Back up normalised visits of landed tables."""
        return backup_visits(self.store, found, as_of=self.as_of, **options)

    def stream_landed(self, found: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        return backup_visit_stream(self.store, found, checkpoint, as_of=self.as_of, **options)

    def stream_files(self, landing: str, checkpoint: str, **options) -> StreamingQuery:
        return backup_file_stream(self.store, landing, checkpoint, as_of=self.as_of, **options)

    def stream_history(self, landing: str, checkpoint: str, **options) -> StreamingQuery:
        """Back up history files below a folder whenever they land or change."""
        return backup_history_stream(self.store, landing, checkpoint, as_of=self.as_of, **options)

    def backup_landing(self, homes: Sequence[str] = (), paths: Sequence[str] = (), **options) -> BackupResult:
        """Back up history files from any file system that Spark reads, by URIs."""
        with Staging(self.store.spark, "landing") as staging:
            source = read_landing(self.store.spark, staging, homes, paths)
            return backup_source(self.store, source, as_of=self.as_of, **options)

    def search(
        self,
        start: str | None = None,
        end: str | None = None,
        keyword: str | None = None,
        *,
        case_sensitive: bool = False,
        limit: int | None = None,
    ) -> DataFrame:
        span = self._range(start, end)
        return search.search_visits(
            self.store.visits_matching(span, keyword),
            span,
            keyword,
            case_sensitive=case_sensitive,
            limit=limit,
            compat=self.compat,
        )

    def page(
        self,
        start: str | None = None,
        end: str | None = None,
        keyword: str | None = None,
        *,
        case_sensitive: bool = False,
        after: paging.Cursor | None = None,
        size: int = 500,
    ) -> paging.Page:
        """One page of a search in time order; pass its ``next`` to get the following one."""
        return paging.search_page(
            lambda days: self.store.visits_matching(days, keyword),
            self.store.visit_days(),
            self._range(start, end),
            keyword,
            case_sensitive=case_sensitive,
            after=after,
            size=size,
        )

    def index_keywords(self) -> None:
        """Let searches skip files that cannot hold their keyword. Compaction does it, too."""
        self.store.index_keywords()

    def details(self, ymd: str, keyword: str | None = None, *, case_sensitive: bool = False) -> DataFrame:
        return search.day_details(self.store.visits(), ymd, self.store.zone, keyword, case_sensitive)

    def dashboard(
        self,
        start: str | None = None,
        end: str | None = None,
        keyword: str | None = None,
        *,
        case_sensitive: bool = False,
    ) -> Dashboard:
        return dashboard(
            self.store.visits(),
            self._range(start, end),
            self.as_of,
            self.store.zone,
            keyword,
            compat=self.compat,
            case_sensitive=case_sensitive,
            edges=self.store.edge_visits(),
        )

    def daily(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Visits per day, from the figures that backups keep."""
        return rollups.daily_counts(self.store.rollups(), self.store.visits(), self._range(start, end))

    def top(self, kind: str = "domain", start: str | None = None, end: str | None = None, k: int = aggregates.TOP_K) -> DataFrame:
        """The most frequent titles or domains, from the lists per day where these decide."""
        store = self.store
        lists = store.read_table("toplists")
        return toplists.top(lists, store.rollups(), store.visits(), self._range(start, end), kind, k)[0]

    def key_figures(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Key figures from these; distinct counts are estimates."""
        today = ranges.today_range(self.as_of, self.store.zone)
        return rollups.kpi_stats(self.store.rollups(), self.store.visits(), self._range(start, end), today)

    def status(self) -> DataFrame:
        """One row: totals, first and last visit, files, and the store's path and size."""
        status = aggregates.store_status(
            self.store.visits(), self._imports(), self.store.edge_visits(), self.store.size_bytes()
        )
        return status.select(
            "total_visits", "min_ms", "max_ms", "n_files", F.lit(self.store.path).alias("path"), "size_bytes"
        )

    def store_size(self) -> DataFrame:
        return self.store.size()

    def import_history(self) -> DataFrame:
        return aggregates.import_history(self._imports())

    def browsers(self) -> DataFrame:
        return aggregates.browser_breakdown(self.store.visits())

    def sources(self) -> DataFrame:
        return aggregates.source_record_counts(self.store.visits(), self._imports())

    def export(self, folder: str) -> None:
        everything = ranges.full_range(self.as_of, self.store.zone)
        export_csv(self.store.visits(), everything, folder, compat=self.compat)

    def detected(self, homes: Sequence[str]) -> DataFrame:
        """History files below home directories, without importing them."""
        return list_history_files(self.store.spark, homes)

    def compact(self, days: Sequence[date] | None = None) -> None:
        compact(self.store, days)

    def _imports(self) -> DataFrame:
        return ingest.latest_imports(self.store.import_log())
