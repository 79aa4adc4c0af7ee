"""Figures per day that backups keep, so that panels need not scan the visits.

Each backup appends, for what it has newly stored, the visits of each quarter of an hour
and, per UTC day, mergeable sketches of its urls and domains. Counts add up and sketches
unite, in whatever batches the visits came. A ``snapshot`` of a day stands for all of it:
compaction writes one, and so does the repair after a run that died between visits and
figures; older rows of the day no longer count.

A panel takes whole quarters and whole days from here and scans visits at the two ends of
its range only, so counts are exact. Sketches with ``LG_K`` = 12 estimate distinct values
within about 1.6 % (one standard error). Quarters make local days in all zones whose
offset is a multiple of 15 minutes, which all are since 1972.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.predicates import in_range
from visitlake.functions.ranges import TimeRange

LG_K = 12
QUARTER_US = 900_000_000
DAY_US = 96 * QUARTER_US
WHOLE_DAY = -1  # in place of a quarter: the row with a day's sketches
_KEYS = ("visit_day", "quarter")


def figures(visits: DataFrame) -> DataFrame:
    """visit_day, quarter, n_visits, urls, domains of some visits."""
    time = F.col("visit_time")
    day = scalars.utc_day(time).alias("visit_day")
    quarter = F.floor(F.pmod(time, F.lit(DAY_US)) / QUARTER_US).cast("int").alias("quarter")
    blank = F.lit(None).cast("binary")
    counts = visits.groupBy(day, quarter).agg(F.count(F.lit(1)).alias("n_visits"))
    sketches = visits.groupBy(day).agg(
        F.count(F.lit(1)).alias("n_visits"), _sketch(F.col("url")).alias("urls"),
        _sketch(scalars.domain_of(F.col("url"))).alias("domains"),
    )
    return counts.select(*_KEYS, "n_visits", blank.alias("urls"), blank.alias("domains")).unionByName(
        sketches.withColumn("quarter", F.lit(WHOLE_DAY))
    )


def _sketch(value: Column) -> Column:
    return F.hll_sketch_agg(value, LG_K)


def merged(rows: DataFrame) -> DataFrame:
    """One row per day and quarter, from all rows that count."""
    snapshots = rows.filter("snapshot").groupBy("visit_day").agg(F.max("seq").alias("base"))
    live = rows.join(snapshots, "visit_day", "left").filter(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
    return live.groupBy(*_KEYS).agg(
        F.sum("n_visits").alias("n_visits"),
        F.hll_union_agg("urls").alias("urls"),
        F.hll_union_agg("domains").alias("domains"),
    )


def _counts(rows: DataFrame) -> DataFrame:
    """time (of the quarter's start), n of each quarter; reads no sketch."""
    snapshots = rows.filter("snapshot").groupBy("visit_day").agg(F.max("seq").alias("base"))
    live = rows.filter(F.col("quarter") != WHOLE_DAY).join(snapshots, "visit_day", "left")
    live = live.filter(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
    start = F.unix_date("visit_day").cast("bigint") * DAY_US + F.col("quarter").cast("bigint") * QUARTER_US
    return live.select(start.alias("time"), F.col("n_visits").alias("n"))


def _ends(visits: DataFrame, span: TimeRange, unit: int) -> DataFrame:
    """Visits of the range outside the whole units in it, which lie in two days at most."""
    first = -(-span.start_us // unit) * unit
    last = (span.end_us + 1) // unit * unit  # where the last whole unit ends
    if first >= last:
        return visits.filter(in_range(visits, span))
    out = visits.filter(in_range(visits, TimeRange(last // 1000, span.end_ms)))
    if first > span.start_us:
        head = visits.filter(in_range(visits, TimeRange(span.start_ms, first // 1000)))
        out = out.unionByName(head.filter(F.col("visit_time") < first))
    return out


def _inside(time: Column, span: TimeRange, unit: int) -> Column:
    return (time >= span.start_us) & (time + (unit - 1) <= span.end_us)


def visits_by_time(rows: DataFrame, visits: DataFrame, span: TimeRange) -> DataFrame:
    """time, n that add up to the visits of the range: whole quarters, and the visits
    before the first and after the last one."""
    whole = _counts(rows).filter(_inside(F.col("time"), span, QUARTER_US))
    ends = _ends(visits, span, QUARTER_US).select(F.col("visit_time").alias("time"), F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(ends)


def daily_counts(rows: DataFrame, visits: DataFrame, span: TimeRange) -> DataFrame:
    """The same as ``aggregates.daily_counts`` without a keyword."""
    days = visits_by_time(rows, visits, span).groupBy(scalars.local_day(F.col("time")).alias("day"))
    counts = days.agg(F.sum("n").alias("cnt"))
    return counts.select(scalars.day_start_ms(F.col("day")).alias("day_ms"), "cnt").orderBy("day_ms")


def result_count(rows: DataFrame, visits: DataFrame, span: TimeRange) -> DataFrame:
    return visits_by_time(rows, visits, span).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_visits"))


def kpi_stats(rows: DataFrame, visits: DataFrame, span: TimeRange, today: TimeRange) -> DataFrame:
    """Key figures like ``aggregates.kpi_stats``; the distinct counts are estimates."""
    zero = F.lit(0).cast("bigint")
    inside = visits_by_time(rows, visits, span).groupBy(scalars.local_day(F.col("time")).alias("day")).agg(F.sum("n").alias("n"))
    figures_of = inside.agg(
        F.coalesce(F.sum("n"), zero).alias("total_visits"), F.count(F.lit(1)).alias("active_days")
    )
    now = result_count(rows, visits, today).select(F.col("n_visits").alias("today_visits"))
    days = merged(rows.filter(F.col("quarter") == WHOLE_DAY))
    start = F.unix_date("visit_day").cast("bigint") * DAY_US
    sketches = days.filter(_inside(start, span, DAY_US)).select("urls", "domains")
    ends = _ends(visits, span, DAY_US).agg(
        _sketch(F.col("url")).alias("urls"), _sketch(scalars.domain_of(F.col("url"))).alias("domains")
    )
    united = sketches.unionByName(ends).agg(
        F.hll_sketch_estimate(F.hll_union_agg("urls")).alias("unique_urls"),
        F.hll_sketch_estimate(F.hll_union_agg("domains")).alias("unique_domains"),
    )
    parts = figures_of.unionByName(now, allowMissingColumns=True).unionByName(united, allowMissingColumns=True)
    names = ("total_visits", "unique_urls", "active_days", "today_visits", "unique_domains")
    return parts.agg(*(F.coalesce(F.sum(name), zero).alias(name) for name in names))
