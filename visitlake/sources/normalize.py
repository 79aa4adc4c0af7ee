"""Raw browser rows to one visit schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.ranges import TimeRange

FOUND_COLUMNS = ("url", "title", "visit_time", "visit_type", "browser", "data_path", "file_seq", "src_row")

# Columns that tell a landed table's browser, in probing order.
LANDED_COLUMNS = {
    "firefox": {"place_id", "visit_date", "visit_type"},
    "safari": {"history_item", "visit_time"},
    "chrome": {"url", "visit_time", "transition"},
}


def landed_browser(visits: DataFrame | Iterable[str]) -> str:
    """Browser family of a landed visit table, told by its columns."""
    columns = set(visits.columns if isinstance(visits, DataFrame) else visits)
    for browser, needed in LANDED_COLUMNS.items():
        if needed <= columns:
            return browser
    raise ValueError(f"no known browser history columns in {sorted(columns)}")


def _native_filter(visits: DataFrame, column: str, browser: str, span: TimeRange | None) -> DataFrame:
    if span is None:
        return visits
    # The bounds are converted, never the column, so Parquet can skip by them.
    first, last = span.native_bounds(browser)
    return visits.filter(F.col(column).between(first, last))


def _with_pages(visits: DataFrame, key: str, pages: DataFrame, columns: list[str]) -> DataFrame:
    """Visits with their page. Page ids are only unique within one source file."""
    shared = [F.col("v.data_path") == F.col("p.data_path")] if "data_path" in pages.columns else []
    on = reduce(lambda a, b: a & b, [F.col(f"v.{key}") == F.col("p.id"), *shared])
    keep = ["id", *(["data_path"] if shared else []), *columns]
    return visits.alias("v").join(pages.select(*keep).alias("p"), on, "inner")


def normalize_chrome(visits: DataFrame, urls: DataFrame, span: TimeRange | None = None) -> DataFrame:
    rows = _with_pages(_native_filter(visits, "visit_time", "chrome", span), "url", urls, ["url", "title"])
    return rows.select(
        F.col("p.url").alias("url"),
        scalars.title_or_blank(F.col("p.title")).alias("title"),
        scalars.webkit_to_us(F.col("v.visit_time")).alias("visit_time"),
        F.col("v.transition").bitwiseAND(F.lit(0xFF)).cast("bigint").alias("visit_type"),
        F.lit("chrome").alias("browser"),
        F.col("v.data_path").alias("data_path"),
        F.col("v.file_seq").cast("bigint").alias("file_seq"),
        F.col("v.id").alias("src_row"),
    )


def normalize_firefox(visits: DataFrame, places: DataFrame, span: TimeRange | None = None) -> DataFrame:
    rows = _with_pages(
        _native_filter(visits, "visit_date", "firefox", span), "place_id", places, ["url", "title"]
    )
    return rows.select(
        F.col("p.url").alias("url"),
        scalars.title_or_blank(F.col("p.title")).alias("title"),
        F.col("v.visit_date").alias("visit_time"),
        F.col("v.visit_type").cast("bigint").alias("visit_type"),
        F.lit("firefox").alias("browser"),
        F.col("v.data_path").alias("data_path"),
        F.col("v.file_seq").cast("bigint").alias("file_seq"),
        F.col("v.id").alias("src_row"),
    )


def normalize_safari(visits: DataFrame, items: DataFrame, span: TimeRange | None = None) -> DataFrame:
    rows = _with_pages(_native_filter(visits, "visit_time", "safari", span), "history_item", items, ["url"])
    return rows.select(
        F.col("p.url").alias("url"),
        scalars.title_or_blank(F.col("v.title")).alias("title"),
        scalars.nsdate_to_us(F.col("v.visit_time")).alias("visit_time"),
        F.lit(-1).cast("bigint").alias("visit_type"),
        F.lit("safari").alias("browser"),
        F.col("v.data_path").alias("data_path"),
        F.col("v.file_seq").cast("bigint").alias("file_seq"),
        F.col("v.id").alias("src_row"),
    )


_LANDED = {"chrome": normalize_chrome, "firefox": normalize_firefox, "safari": normalize_safari}


def normalize_landed(
    tables: Iterable[tuple[DataFrame, DataFrame]] | Mapping[str, tuple[DataFrame, DataFrame]],
    span: TimeRange | None = None,
) -> DataFrame:
    """Union of landed (visits, pages) table pairs, each told by its columns."""
    pairs = tables.values() if isinstance(tables, Mapping) else tables
    frames = [_LANDED[landed_browser(visits)](visits, pages, span) for visits, pages in pairs]
    return reduce(DataFrame.unionByName, frames)


def normalize_history(raw: DataFrame, keep_status: bool = False) -> DataFrame:
    """Rows of the ``browser_history`` format to normalised visits; with
    ``keep_status`` also the status rows of files, and their error."""
    kind = F.when(
        F.col("browser") == "chrome", F.col("native_type").bitwiseAND(F.lit(0xFF))
    ).otherwise(F.col("native_type"))
    rows = raw if keep_status else raw.filter(F.col("url").isNotNull())
    return rows.select(
        "url",
        scalars.title_or_blank(F.col("title")).alias("title"),
        "visit_time",
        kind.cast("bigint").alias("visit_type"),
        "browser",
        "data_path",
        "file_seq",
        "src_row",
        *(["error"] if keep_status else []),
    )


def file_status(raw: DataFrame) -> DataFrame:
    """One row per file that was opened: data_path and its error, if any."""
    return (
        raw.filter(F.col("url").isNull())
        .groupBy("data_path")
        .agg(F.min("file_seq").alias("file_seq"), F.min("error").alias("error"))
    )
