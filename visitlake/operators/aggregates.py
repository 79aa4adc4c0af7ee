"""Aggregating queries: daily counts, top lists, key figures, breakdowns.

Every grouping here has a map-side partial aggregate, so a value that holds a
third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.predicates import in_range, select_visits
from visitlake.functions.ranges import TimeRange

TOP_K = 100


def _count() -> Column:
    return F.count(F.lit(1)).alias("cnt")


def daily_counts(
    visits: DataFrame, span: TimeRange, keyword: str | None = None, case_sensitive: bool = False
) -> DataFrame:
    """Visits per local day, ascending; days without a visit are absent."""
    rows = select_visits(visits, span, keyword, case_sensitive)
    # Grouped by the DATE and turned into milliseconds per day, not per row.
    return _by_day(rows.groupBy(scalars.local_day(F.col("visit_time")).alias("day")).agg(_count()))


def _by_day(days: DataFrame) -> DataFrame:
    return days.select(scalars.day_start_ms(F.col("day")).alias("day_ms"), "cnt").orderBy("day_ms")


def _titled(visits: DataFrame, span: TimeRange, keyword: str | None, case_sensitive: bool) -> DataFrame:
    return select_visits(visits, span, keyword, case_sensitive).filter(F.col("title") != "")


def _top(counts: DataFrame, name: str, k: int | None) -> DataFrame:
    ranked = counts.orderBy(F.desc("cnt"), F.asc(name))
    return ranked if k is None else ranked.limit(k)


def top_titles(
    visits: DataFrame,
    span: TimeRange,
    keyword: str | None = None,
    k: int | None = TOP_K,
    case_sensitive: bool = False,
) -> DataFrame:
    """Most visited non-blank titles; ties by title."""
    return _top(_titled(visits, span, keyword, case_sensitive).groupBy("title").agg(_count()), "title", k)


def url_counts(
    visits: DataFrame,
    span: TimeRange,
    keyword: str | None = None,
    k: int | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """Visits per url of a titled page, most visited first."""
    return _top(_titled(visits, span, keyword, case_sensitive).groupBy("url").agg(_count()), "url", k)


def top_domains(
    visits: DataFrame,
    span: TimeRange,
    keyword: str | None = None,
    k: int | None = TOP_K,
    compat: bool = False,
    case_sensitive: bool = False,
) -> DataFrame:
    """Most visited domains of titled pages; ties by domain.

    ``compat`` counts each domain's most visited url twice.
    """
    rows = _titled(visits, span, keyword, case_sensitive)
    return _domains(rows, _count(), k, compat)


def _domains(rows: DataFrame, count: Column, k: int | None, compat: bool) -> DataFrame:
    domain = scalars.domain_of(F.col("url")).alias("domain")
    if compat:
        per_url = rows.groupBy("url").agg(count)
        counts = per_url.groupBy(domain).agg((F.sum("cnt") + F.max("cnt")).alias("cnt"))
    else:
        # Straight to the domain: far fewer domains than urls cross the shuffle.
        counts = rows.groupBy(domain).agg(count)
    return _top(counts, "domain", k)


# --- from cells: counts per local day, url and title ---------------------------


def visit_cells(
    visits: DataFrame, span: TimeRange, keyword: str | None = None, case_sensitive: bool = False
) -> DataFrame:
    """day, url, title, cnt of the matching visits: all that the four counting
    panels need, and much less than the visits where pages are seen again."""
    rows = select_visits(visits, span, keyword, case_sensitive)
    return rows.groupBy(scalars.local_day(F.col("visit_time")).alias("day"), "url", "title").agg(_count())


def _total() -> Column:
    return F.sum("cnt").alias("cnt")


def daily_counts_of(cells: DataFrame) -> DataFrame:
    return _by_day(cells.groupBy("day").agg(_total()))


def top_titles_of(cells: DataFrame, k: int | None = TOP_K) -> DataFrame:
    return _top(cells.filter(F.col("title") != "").groupBy("title").agg(_total()), "title", k)


def top_domains_of(cells: DataFrame, k: int | None = TOP_K, compat: bool = False) -> DataFrame:
    return _domains(cells.filter(F.col("title") != ""), _total(), k, compat)


def result_count_of(cells: DataFrame) -> DataFrame:
    return cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_visits"))


def share_of_top(top: DataFrame, name: str, k: int = 10) -> DataFrame:
    """First ``k`` of a top list with each one's percentage of those k.

    The window has no partition key on purpose: it spans at most ``k`` rows.
    """
    first = top.orderBy(F.desc("cnt"), F.asc(name)).limit(k)
    total = F.sum("cnt").over(Window.partitionBy())
    return first.select(
        F.col(name).alias("name"),
        scalars.short_label(F.col(name)).alias("label"),
        "cnt",
        F.round(F.col("cnt") * 100.0 / total, 2).alias("pct"),
    )


def time_span(visits: DataFrame, fallback: TimeRange | None = None) -> DataFrame:
    """First and last visit; an empty store gives the fallback or NULLs.

    For a store pass ``edge_visits()``, its first and last day.
    """
    low = scalars.us_to_ms(F.min("visit_time"))
    high = scalars.us_to_ms(F.max("visit_time"))
    if fallback is not None:
        low = F.coalesce(low, F.lit(fallback.start_ms).cast("bigint"))
        high = F.coalesce(high, F.lit(fallback.end_ms).cast("bigint"))
    return visits.agg(low.alias("min_ms"), high.alias("max_ms"))


def kpi_stats(
    visits: DataFrame,
    span: TimeRange,
    today: TimeRange,
    *,
    approx: bool = False,
    with_domains: bool = False,
) -> DataFrame:
    """Key figures of the range, and the number of today's visits.

    Counts per local day give three of them from the times alone; each distinct
    count is a pass of its own over one column, as several in one pass multiply
    its rows. ``approx`` estimates the distinct counts with sketches, all in one
    pass and without shuffling values.
    """
    inside, now = in_range(visits, span), in_range(visits, today)
    domain = scalars.domain_of(F.col("url"))
    days = (
        visits.filter(inside | now)
        .groupBy(scalars.local_day(F.col("visit_time")).alias("day"))
        .agg(F.count_if(inside).alias("n_inside"), F.count_if(now).alias("n_now"))
    )
    stats = days.agg(
        F.coalesce(F.sum("n_inside"), F.lit(0)).alias("total_visits"),
        F.count_if(F.col("n_inside") > 0).alias("active_days"),
        F.coalesce(F.sum("n_now"), F.lit(0)).alias("today_visits"),
    )
    rows = visits.filter(inside)
    values = {"unique_urls": F.col("url")} | ({"unique_domains": domain} if with_domains else {})
    if approx:
        sketches = [F.approx_count_distinct(v).alias(name) for name, v in values.items()]
        stats = _side_by_side(stats, rows.agg(*sketches))
    else:
        for name, v in values.items():
            stats = _side_by_side(stats, rows.agg(F.count_distinct(v).alias(name)))
    return stats.select("total_visits", "unique_urls", "active_days", "today_visits", *list(values)[1:])


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row out of two one-row frames of numbers, without a join."""
    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.agg(*(F.sum(name).alias(name) for name in rows.columns))


def browser_breakdown(visits: DataFrame) -> DataFrame:
    """Visits per browser family, credited to the file that brought them first."""
    return visits.groupBy("browser").agg(F.count(F.lit(1)).alias("n_visits"))


def source_record_counts(visits: DataFrame, imports: DataFrame) -> DataFrame:
    """Import records with the number of stored visits of each file."""
    counts = visits.groupBy("data_path").agg(F.count(F.lit(1)).alias("n"))
    return imports.join(counts, "data_path", "left").select(
        "data_path",
        scalars.us_to_ms(F.col("last_import")).alias("last_import_ms"),
        F.coalesce("n", F.lit(0)).alias("n_visits"),
    )


def store_status(
    visits: DataFrame, imports: DataFrame, edges: DataFrame | None = None, size_bytes: int | None = None
) -> DataFrame:
    """One row: visit total, first and last visit (0 when empty), files imported and,
    if given, the store's size.

    ``imports`` is the latest record per file. The records themselves are the
    separate frame ``import_history``: their number is not bounded, so they do
    not go into one row. With ``edges``, the visits of the first and last day, no
    column of the others is read.
    """
    zero = F.lit(0).cast("bigint")
    total = F.count(F.lit(1)).alias("total_visits")
    ends = [
        scalars.us_to_ms(F.coalesce(F.min("visit_time"), zero)).alias("min_ms"),
        scalars.us_to_ms(F.coalesce(F.max("visit_time"), zero)).alias("max_ms"),
    ]
    if edges is None:
        totals = visits.agg(total, *ends)
    else:
        totals = _side_by_side(visits.agg(total), edges.agg(*ends))
    files = imports.agg(F.count(F.lit(1)).alias("n_files"))
    status = _side_by_side(totals, files)
    return status if size_bytes is None else status.withColumn("size_bytes", F.lit(size_bytes).cast("bigint"))


def import_history(imports: DataFrame) -> DataFrame:
    """Latest import record per file, most recent first."""
    return imports.orderBy(F.desc("last_import"), F.asc("data_path")).select(
        "data_path", scalars.us_to_ms(F.col("last_import")).alias("last_import_ms")
    )
