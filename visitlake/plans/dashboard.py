"""All panels of the overview for one range and keyword."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import tzinfo

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from visitlake.functions import ranges
from visitlake.functions.ranges import TimeRange
from visitlake.operators import aggregates, search


@dataclass
class Dashboard:
    """Lazy panels. Use as a context manager to free the shared counts."""

    daily: DataFrame
    titles: DataFrame
    domains: DataFrame
    result_count: DataFrame
    span: DataFrame
    stats: DataFrame
    cells: DataFrame | None

    def __enter__(self) -> Dashboard:
        return self

    def __exit__(self, *exc) -> None:
        if self.cells is not None:
            self.cells.unpersist()


def dashboard(
    visits: DataFrame,
    span: TimeRange,
    as_of,
    tz: tzinfo,
    keyword: str | None = None,
    *,
    k: int = aggregates.TOP_K,
    compat: bool = False,
    case_sensitive: bool = False,
    keep_counts: bool = True,
    edges: DataFrame | None = None,
) -> Dashboard:
    """Daily counts, top lists and result count of the matching visits; key
    figures and time span ignore the keyword.

    With a keyword the text is searched once: the matches are counted by day, url
    and title, these counts are kept, and four panels are sums over them. Turn
    ``keep_counts`` off if nobody will close the dashboard. Without a keyword
    nothing is kept: each panel then reads only its own columns, which is cheaper
    than counting the whole range. ``edges`` are the visits of the first and last
    day, which give the time span of a store.
    """
    shared = {
        "span": aggregates.time_span(visits if edges is None else edges, fallback=ranges.full_range(as_of, tz)),
        "stats": aggregates.kpi_stats(visits, span, ranges.today_range(as_of, tz)),
    }
    if keyword is None:
        return Dashboard(
            daily=aggregates.daily_counts(visits, span),
            titles=aggregates.top_titles(visits, span, None, k),
            domains=aggregates.top_domains(visits, span, None, k, compat),
            result_count=search.result_count(visits, span),
            cells=None,
            **shared,
        )
    cells = aggregates.visit_cells(visits, span, keyword, case_sensitive)
    if keep_counts:
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    return Dashboard(
        daily=aggregates.daily_counts_of(cells),
        titles=aggregates.top_titles_of(cells, k),
        domains=aggregates.top_domains_of(cells, k, compat),
        result_count=aggregates.result_count_of(cells),
        cells=cells if keep_counts else None,
        **shared,
    )
