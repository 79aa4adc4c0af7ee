"""Browsing-history analytics on Spark: ingest, store and query visit logs."""

from visitlake.functions.ranges import TimeRange, day_range, full_range, resolve_range
from visitlake.sources.store import VisitStore

__all__ = ["TimeRange", "VisitStore", "day_range", "full_range", "resolve_range"]
