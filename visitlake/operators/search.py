"""Row-returning queries: search, day drill-down, refinement, result count."""

from __future__ import annotations

from datetime import tzinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions import ranges, scalars
from visitlake.functions.predicates import refine_matches, select_visits
from visitlake.functions.ranges import TimeRange


def search_visits(
    visits: DataFrame,
    span: TimeRange,
    keyword: str | None = None,
    *,
    case_sensitive: bool = False,
    limit: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Visits in time order: url, title, visit_ms, visit_type.

    ``compat`` reports every visit type as 0. ``limit`` turns the full sort into
    a top-k.
    """
    found = select_visits(visits, span, keyword, case_sensitive).orderBy("visit_time", "url")
    if limit is not None:
        found = found.limit(limit)
    kind = F.lit(0).cast("bigint") if compat else F.col("visit_type")
    return found.select(
        "url",
        scalars.title_or_blank(F.col("title")).alias("title"),
        scalars.us_to_ms(F.col("visit_time")).alias("visit_ms"),
        kind.alias("visit_type"),
    )


def day_details(
    visits: DataFrame, ymd: str, tz: tzinfo, keyword: str | None = None, case_sensitive: bool = False
) -> DataFrame:
    """One local day's visits with clock time and the title to show."""
    found = search_visits(visits, ranges.day_range(ymd, tz), keyword, case_sensitive=case_sensitive)
    return found.select(
        "visit_ms",
        scalars.ms_to_hms(F.col("visit_ms")).alias("hms"),
        scalars.display_title(F.col("title"), F.col("url")).alias("shown_title"),
        "url",
        "title",
        "visit_type",
    )


def refine(found: DataFrame, query: str) -> DataFrame:
    """Narrow a search result by a literal substring; '' keeps everything."""
    return found.filter(refine_matches(query)) if query else found


def result_count(
    visits: DataFrame, span: TimeRange, keyword: str | None = None, case_sensitive: bool = False
) -> DataFrame:
    return select_visits(visits, span, keyword, case_sensitive).agg(F.count(F.lit(1)).alias("n_visits"))
