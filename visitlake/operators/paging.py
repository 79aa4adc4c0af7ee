"""Pages of a search in time order, read day by day.

A page starts after a cursor and ends when it is full. Days are read in order, one at
first and then twice as many each time, so a page of frequent matches reads one day's
files and a rare keyword needs few jobs. Nothing but the page comes to the driver, or
with ``Ahead`` a bounded number of rows that the next pages are taken from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions.predicates import select_visits
from visitlake.functions.ranges import TimeRange

MOST_ROWS = 10_000
MOST_AHEAD = 50_000


@dataclass(frozen=True)
class Cursor:
    """The last visit of a page; a store has each (visit_time, url) once."""

    visit_time: int
    url: str


@dataclass(frozen=True)
class Page:
    """Rows as stored, in order, and where the next page starts; None after the last."""

    rows: list
    next: Cursor | None


class Ahead:
    """What a reader of page after page has read beyond the last one: at most ``most``
    rows, so that one job serves several pages. It holds for one search."""

    def __init__(self, most: int = MOST_AHEAD):
        self.most = most
        self.start: Cursor | None = None
        self.rows: list = []

    def keep(self, start: Cursor, rows: list) -> None:
        self.start, self.rows = start, rows

    def take(self, after: Cursor | None, size: int) -> list:
        """The rows that follow the cursor, if there are more than ``size``."""
        rows = self.rows if after is not None and after == self.start else []
        self.start, self.rows = None, []
        return rows if len(rows) > size else []


def _after(visits: DataFrame, cursor: Cursor | None) -> DataFrame:
    if cursor is None:
        return visits
    time, url = F.col("visit_time"), F.col("url")
    # The first bound alone reaches the files.
    return visits.filter((time >= cursor.visit_time) & ((time > cursor.visit_time) | (url > cursor.url)))


def search_page(
    visits: Callable[[list[date]], DataFrame],
    days: list[date],
    span: TimeRange,
    keyword: str | None = None,
    *,
    case_sensitive: bool = False,
    after: Cursor | None = None,
    size: int = 500,
    ahead: Ahead | None = None,
) -> Page:
    """``days`` are those that have visits, in order; ``visits`` gives the rows of some.

    With ``ahead`` a job brings the rows of several pages. The days that it starts with
    are those of the page alone, and what it has brought is given to the next calls.
    """
    if not 0 < size <= MOST_ROWS:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
    rows = ahead.take(after, size) if ahead is not None else []
    if rows:
        return _page(rows, size, ahead)
    most = size if ahead is None else max(size, ahead.most)
    first, last = span.utc_days
    left = [day for day in days if first <= day <= last]
    if after is not None:
        start = TimeRange(after.visit_time // 1000, span.end_ms).utc_days[0]
        left = [day for day in left if day >= start]
    at, width = 0, 1
    while at < len(left) and len(rows) <= size:
        found = _after(select_visits(visits(left[at : at + width]), span, keyword, case_sensitive), after)
        # One row more tells whether there is a next page.
        rows += found.orderBy("visit_time", "url").limit(most + 1 - len(rows)).collect()
        at, width = at + width, 2 * width
    return _page(rows, size, ahead)


def _page(rows: list, size: int, ahead: Ahead | None) -> Page:
    """The first rows; more than ``size`` tell that there is a next page."""
    page, rest = rows[:size], rows[size:]
    if not rest:
        return Page(page, None)
    cursor = Cursor(page[-1]["visit_time"], page[-1]["url"])
    if ahead is not None:
        ahead.keep(cursor, rest)
    return Page(page, cursor)


def pages(fetch: Callable[[Cursor | None], Page]) -> Iterator[Page]:
    """All pages, one after the other."""
    cursor = None
    while True:
        page = fetch(cursor)
        yield page
        if page.next is None:
            return
        cursor = page.next
