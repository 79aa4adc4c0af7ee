"""Row predicates shared by all query operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.functions.ranges import TimeRange


def in_range(frame: DataFrame, span: TimeRange) -> Column:
    """Inclusive range on ``visit_time``.

    On a frame with the ``visit_day`` partition column the matching UTC days are
    named as well: Catalyst cannot derive partition filters from the microsecond
    bounds on its own.
    """
    cond = F.col("visit_time").between(span.start_us, span.end_us)
    if "visit_day" in frame.columns:
        first, last = span.utc_days
        cond = cond & F.col("visit_day").between(F.lit(first), F.lit(last))
    return cond


def like_pattern(keyword: str) -> str:
    """Java regex for "contains keyword" with the wildcards '%' and '_'.

    Backslash is an ordinary character here, as there is no escape.
    """
    out = []
    for ch in keyword.strip("%"):
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif re.match(r"[A-Za-z0-9\s]|[^\x00-\x7f]", ch):
            out.append(ch)
        else:
            out.append("\\x{%x}" % ord(ch))
    return "".join(out)


def keyword_matches(keyword: str | None, case_sensitive: bool = False) -> Column | None:
    """``url`` or ``title`` contains the keyword; None when there is no filter.

    Case folding is ASCII only. Java's ``(?i)`` without ``(?u)`` is exactly that
    and, on long scans, far cheaper than folding every string with translate().
    A keyword that has nothing to fold and no wildcard becomes a plain contains().
    """
    if keyword is None or keyword.strip("%") == "":
        return None
    wildcards = "%" in keyword.strip("%") or "_" in keyword
    folds = not case_sensitive and re.search("[A-Za-z]", keyword) is not None

    def test(column: str) -> Column:
        if not wildcards and not folds:
            return F.contains(F.col(column), F.lit(keyword.strip("%")))
        return F.col(column).rlike(("(?is)" if folds else "(?s)") + like_pattern(keyword))

    return test("url") | test("title")


def refine_matches(query: str) -> Column:
    """Literal, Unicode case-insensitive substring test on url or title."""
    needle = F.lower(F.lit(query))
    return F.contains(F.lower(F.col("url")), needle) | F.contains(
        F.lower(F.coalesce(F.col("title"), F.lit(""))), needle
    )


def select_visits(
    visits: DataFrame,
    span: TimeRange,
    keyword: str | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """The common scaffold of the query operators: range, then keyword."""
    out = visits.filter(in_range(visits, span))
    matches = keyword_matches(keyword, case_sensitive)
    return out if matches is None else out.filter(matches)
