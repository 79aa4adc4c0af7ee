"""Time ranges, resolved on the driver to inclusive millisecond bounds.

``as_of`` is always an argument so that "today" and the default window are
reproducible; ``None`` means now.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from visitlake.functions.scalars import DAY_MS, NSDATE_TO_UNIX_SECONDS, WEBKIT_TO_UNIX_SECONDS

DEFAULT_WINDOW_DAYS = 30

_YMD = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})")
_OFFSET = re.compile(r"(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2}))?")


@dataclass(frozen=True)
class TimeRange:
    """Inclusive bounds in milliseconds since 1970."""

    start_ms: int
    end_ms: int

    @property
    def start_us(self) -> int:
        return self.start_ms * 1000

    @property
    def end_us(self) -> int:
        return self.end_ms * 1000

    @property
    def utc_days(self) -> tuple[date, date]:
        return _utc_date(self.start_ms), _utc_date(self.end_ms)

    def native_bounds(self, browser: str) -> tuple[int, int] | tuple[float, float]:
        """The bounds in a browser's own encoding, so raw columns stay bare."""
        if browser == "chrome":
            shift = WEBKIT_TO_UNIX_SECONDS * 1_000_000
            return self.start_us + shift, self.end_us + shift
        if browser == "firefox":
            return self.start_us, self.end_us
        if browser == "safari":
            return (
                self.start_ms / 1000.0 - NSDATE_TO_UNIX_SECONDS,
                self.end_ms / 1000.0 - NSDATE_TO_UNIX_SECONDS,
            )
        raise ValueError(f"unknown browser: {browser}")


def _utc_date(ms: int) -> date:
    days = ms // DAY_MS + date(1970, 1, 1).toordinal()
    return date.fromordinal(min(max(days, 1), date.max.toordinal()))


def session_zone(spark: SparkSession) -> tzinfo:
    return zone(spark.conf.get("spark.sql.session.timeZone"))


def zone(name: str) -> tzinfo:
    if name in ("Z", "UTC", "GMT"):
        return timezone.utc
    offset = _OFFSET.fullmatch(name)
    if offset:
        sign = -1 if offset.group(1) == "-" else 1
        span = timedelta(hours=int(offset.group(2)), minutes=int(offset.group(3) or 0))
        return timezone(sign * span)
    return ZoneInfo(name)


def parse_day(text: str) -> date:
    found = _YMD.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a year-month-day date: {text!r}")
    return date(*(int(part) for part in found.groups()))


def midnight_ms(day: date | str, tz: tzinfo) -> int:
    """First instant of a local day. A midnight skipped by DST moves forward."""
    if isinstance(day, str):
        day = parse_day(day)
    start = datetime(day.year, day.month, day.day, tzinfo=tz)
    return int(start.timestamp()) * 1000


def tomorrow_ms(as_of: date | datetime | str | None, tz: tzinfo) -> int:
    """Local midnight of ``as_of`` plus a fixed 24 hours."""
    if as_of is None:
        as_of = datetime.now(tz)
    if isinstance(as_of, datetime):
        as_of = (as_of.astimezone(tz) if as_of.tzinfo else as_of).date()
    return midnight_ms(as_of, tz) + DAY_MS


def full_range(as_of: date | datetime | str | None, tz: tzinfo) -> TimeRange:
    """Everything a backup accepts: from 1970 up to tomorrow midnight."""
    return TimeRange(0, tomorrow_ms(as_of, tz))


def today_range(as_of: date | datetime | str | None, tz: tzinfo) -> TimeRange:
    tomorrow = tomorrow_ms(as_of, tz)
    return TimeRange(tomorrow - DAY_MS, tomorrow - 1)


def day_range(ymd: str, tz: tzinfo) -> TimeRange:
    """Day drill-down bounds; the next midnight itself is included."""
    start = midnight_ms(ymd, tz)
    return TimeRange(start, start + DAY_MS)


def resolve_range(
    start: str | None,
    end: str | None,
    as_of: date | datetime | str | None,
    tz: tzinfo,
) -> TimeRange:
    """Optional day strings to bounds; the default is the last 30 days.

    Raises ``ValueError`` for a date that cannot be read.
    """
    tomorrow = tomorrow_ms(as_of, tz)
    end_ms = tomorrow - 1 if end is None else midnight_ms(end, tz) + DAY_MS - 1
    start_ms = tomorrow - DEFAULT_WINDOW_DAYS * DAY_MS if start is None else midnight_ms(start, tz)
    return TimeRange(start_ms, end_ms)
