"""Scalar column functions. Everything here stays inside Catalyst: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch distances and the fixed length of a day.
WEBKIT_TO_UNIX_SECONDS = 11644473600
NSDATE_TO_UNIX_SECONDS = 978307200
DAY_MS = 86_400_000
DAY_US = DAY_MS * 1000

# Meaning of visit_type per browser family (Safari has none).
VISIT_TYPE_LABELS = {
    "firefox": {
        1: "link",
        2: "typed",
        3: "bookmark",
        4: "embed",
        5: "redirect (permanent)",
        6: "redirect (temporary)",
        7: "download",
        8: "framed link",
    },
    "chrome": {
        0: "link",
        1: "typed",
        2: "auto bookmark",
        3: "auto subframe",
        4: "manual subframe",
        7: "form submit",
        8: "reload",
    },
}


# --- epochs -----------------------------------------------------------------


def webkit_to_us(t: Column) -> Column:
    """Microseconds since 1601 to microseconds since 1970."""
    return t - F.lit(WEBKIT_TO_UNIX_SECONDS * 1_000_000)


def us_to_webkit(t: Column) -> Column:
    return t + F.lit(WEBKIT_TO_UNIX_SECONDS * 1_000_000)


def nsdate_to_us(t: Column) -> Column:
    """Float seconds since 2001 to whole microseconds since 1970, truncated."""
    return ((t + F.lit(float(NSDATE_TO_UNIX_SECONDS))) * F.lit(1_000_000.0)).cast("bigint")


def us_to_nsdate(t: Column) -> Column:
    return t.cast("double") / F.lit(1_000_000.0) - F.lit(float(NSDATE_TO_UNIX_SECONDS))


def ms_to_us(t: Column) -> Column:
    return t * F.lit(1000)


def us_to_ms(t: Column) -> Column:
    """Whole milliseconds, truncated towards zero."""
    return F.call_function("div", t, F.lit(1000))


# --- calendar ---------------------------------------------------------------


def utc_day(t_us: Column) -> Column:
    """UTC calendar day of a microsecond instant, whatever the session zone."""
    return F.date_from_unix_date(F.call_function("div", t_us, F.lit(DAY_US)).cast("int"))


def local_day(t_us: Column) -> Column:
    """Calendar day in the session time zone."""
    return F.timestamp_micros(t_us).cast("date")


def day_start_ms(day: Column) -> Column:
    """First instant of a DATE in the session time zone, as milliseconds."""
    return F.unix_millis(day.cast("timestamp"))


def ymd_to_ms(ymd: Column) -> Column:
    """'2024-01-05' or '2024-1-5' to the start of that local day."""
    return F.unix_millis(F.to_timestamp(ymd, "y-M-d"))


def ms_to_ymd(t_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(t_ms), "yyyy-MM-dd")


def ms_to_hms(t_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(t_ms), "HH:mm:ss")


def ms_to_ymdhms(t_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(t_ms), "yyyy-MM-dd HH:mm:ss")


def previous_ymd(t_ms: Column) -> Column:
    return ms_to_ymd(t_ms - F.lit(DAY_MS))


def next_ymd(t_ms: Column) -> Column:
    return ms_to_ymd(t_ms + F.lit(DAY_MS))


# --- text -------------------------------------------------------------------


def domain_of(url: Column) -> Column:
    """Text between '://' and the next '/', or the whole url without one.

    ``(?d)`` limits what '.' refuses to a plain newline, as in most non-Java
    regex dialects.
    """
    host = F.regexp_extract(url, r"(?d)://(.+?)/", 1)
    return F.coalesce(F.nullif(host, F.lit("")), url)


def title_or_blank(title: Column) -> Column:
    return F.coalesce(title, F.lit(""))


def display_title(title: Column, url: Column) -> Column:
    return F.when(title_or_blank(title) == "", url).otherwise(title)


def short_label(name: Column, width: int = 50) -> Column:
    """First ``width`` characters and an ellipsis when the name is longer."""
    cut = F.concat(F.substring(name, 1, width), F.lit("…"))
    return F.when(F.length(name) > width, cut).otherwise(name)


def size_label(n_bytes: Column) -> Column:
    kib = n_bytes / F.lit(1024.0)
    return (
        F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" B")))
        .when(n_bytes < 1024 * 1024, F.format_string("%.1f KB", kib))
        .otherwise(F.format_string("%.2f MB", kib / F.lit(1024.0)))
    )


def time_label(t_ms: Column) -> Column:
    """Local date and time, or a dash for the 'no time' value 0."""
    return F.when(F.coalesce(t_ms, F.lit(0)) == 0, F.lit("—")).otherwise(ms_to_ymdhms(t_ms))


def visit_type_label(browser: Column, visit_type: Column) -> Column:
    """Meaning of a visit type code; NULL for unknown codes and browsers."""
    label = F.lit(None).cast("string")
    for family, codes in VISIT_TYPE_LABELS.items():
        pairs = [c for code, text in codes.items() for c in (F.lit(code).cast("bigint"), F.lit(text))]
        known = F.element_at(F.create_map(*pairs), visit_type)
        label = F.when(browser == family, known).otherwise(label)
    return label
