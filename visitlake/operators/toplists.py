"""Exact top lists of a range from top lists per day.

Each indexed day has its ``LISTED`` most frequent names with their counts, and the least
of these as a bound for every other name. The sum of bounds limits any name that no list
has; while that reaches the k-th best count known, days are read in full, those with the
largest bounds first. Then only names can win that a list or a full day has, and of these
only days are read in which one that may win is not listed. On skewed data that is few or
none; on flat data it is all, as it has to be.

A day's list holds while the day has as many visits as when it was made, which the figures
of ``rollups`` tell; other days, and the ends of a range that are no whole days, are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.predicates import in_range
from visitlake.functions.ranges import TimeRange
from visitlake.operators import rollups

LISTED = 1_000
# Candidates that are broadcast, some ten megabytes.
MOST_BROADCAST = 100_000
KINDS: dict[str, Callable[[], Column]] = {
    "title": lambda: F.col("title"),
    "domain": lambda: scalars.domain_of(F.col("url")),
}


def _counts(visits: DataFrame, kind: str, *keys: str) -> DataFrame:
    """name, n of titled visits, by further keys."""
    named = visits.filter(F.col("title") != "").select(*keys, KINDS[kind]().alias("name"))
    return named.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))


def day_lists(visits: DataFrame, listed: int = LISTED) -> DataFrame:
    """visit_day, kind, name, n, rest, n_visits of whole days. A day without titled
    visits has one row without a name for each kind."""
    size = visits.groupBy("visit_day").agg(F.count(F.lit(1)).alias("n_visits"))
    order = Window.partitionBy("visit_day").orderBy(F.desc("n"), F.asc("name"))
    out = None
    for kind in KINDS:
        top = _counts(visits, kind, "visit_day").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
        rest = top.groupBy("visit_day").agg(F.min("n").alias("least"), F.max("rank").alias("held"))
        full = F.when(F.col("held") >= listed, F.col("least")).otherwise(0).cast("bigint")
        days = size.join(rest, "visit_day", "left").select("visit_day", "n_visits", full.alias("rest"))
        rows = days.join(top.drop("rank"), "visit_day", "left").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select("visit_day", "kind", "name", "n", "rest", "n_visits")


@dataclass
class _Day:
    day: date
    rest: int


def valid_days(lists: DataFrame, figures: DataFrame, kind: str, span: TimeRange) -> list[_Day]:
    """Whole days of the range whose lists still hold; bounded by the calendar."""
    start = F.unix_date("visit_day").cast("bigint") * rollups.DAY_US
    inside = (start >= span.start_us) & (start + (rollups.DAY_US - 1) <= span.end_us)
    made = lists.filter(F.col("kind") == kind).filter(inside).groupBy("visit_day").agg(
        F.max("rest").alias("rest"), F.max("n_visits").alias("n_then")
    )
    now = rollups.merged(figures.filter(F.col("quarter") == rollups.WHOLE_DAY)).select("visit_day", "n_visits")
    same = made.join(now, "visit_day").filter(F.col("n_then") == F.col("n_visits"))
    return [_Day(row["visit_day"], row["rest"] or 0) for row in same.select("visit_day", "rest").collect()]


def top(lists: DataFrame, figures: DataFrame, visits: DataFrame, span: TimeRange, kind: str, k: int) -> tuple[DataFrame, list[date]]:
    """The ``k`` most frequent names of the range, with column ``kind`` and cnt, ties by
    name, like ``aggregates``; and the whole days with a list that were not read."""
    held = sorted(valid_days(lists, figures, kind, span), key=lambda d: -d.rest)
    lists = lists.filter((F.col("kind") == kind) & F.col("name").isNotNull()).select("visit_day", "name", "n", "rest")
    inside = visits.filter(in_range(visits, span))

    def on(frame: DataFrame, days: list[_Day]) -> DataFrame:
        return frame.filter(F.col("visit_day").isin([d.day for d in days]))

    def known(days: list[_Day]) -> DataFrame:
        """name, n, and the bounds of the days that list it, all others read in full."""
        read = inside.filter(~F.col("visit_day").isin([d.day for d in days])) if days else inside
        rows = _counts(read, kind).withColumn("own", F.lit(0).cast("bigint"))
        if days:
            rows = rows.unionByName(on(lists, days).select("name", "n", F.col("rest").alias("own")))
        return rows.groupBy("name").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))

    step = 1
    while True:
        best = known(held).orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("found")).first()
        least = best["least"] if best["found"] >= k else 0
        unseen = sum(d.rest for d in held)
        if not held or unseen == 0 or unseen < least:
            break
        held, step = held[step:], step * 2
    upper = F.col("n") + unseen - F.col("own")
    may_win = known(held).filter(upper >= least).select("name")
    if held and unseen:
        n = may_win.count()
        names = F.broadcast(may_win) if n <= MOST_BROADCAST else may_win
        listed = on(lists, held).join(names, "name", "left_semi").groupBy("visit_day").agg(F.count(F.lit(1)).alias("n"))
        complete = {row["visit_day"] for row in listed.filter(F.col("n") == n).collect()}
        held = [d for d in held if d.rest == 0 or d.day in complete]
        rows = known(held).join(names, "name", "left_semi")
    else:
        rows = known(held)
    ranked = rows.orderBy(F.desc("n"), F.asc("name")).limit(k).select(F.col("name").alias(kind), F.col("n").alias("cnt"))
    return ranked, sorted(d.day for d in held)
