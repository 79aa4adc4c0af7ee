"""Figures kept per day equal those of a scan, however the visits came."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import DAY_US, NOON, found, scanned, tuples
from test_ingest import rows_of
from visitlake.functions import ranges as R
from visitlake.functions.ranges import TimeRange
from visitlake.operators import aggregates, rollups, search
from visitlake.plans import compaction
from visitlake.plans.backup import backup_visits
from visitlake.plans.history import History
from visitlake.sources.store import VisitStore

AS_OF = "2024-01-30"


def batch(rng, n):
    return [
        (f"http://h{rng.randrange(9)}/{rng.randrange(300)}", "t", NOON + rng.randrange(-8 * DAY_US, 8 * DAY_US), 1)
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(4)
    store = VisitStore.create(spark, str(tmp_path_factory.mktemp("store")))
    first = batch(rng, 600)
    for seq, rows in enumerate((first, first[:200] + batch(rng, 300), first, batch(rng, 400))):
        backup_visits(store, found(spark, rows_of(seq, f"/f{seq}", rows)), as_of=AS_OF)
        if seq == 2:
            compaction.compact(store)
    return store


def spans(zone):
    day = R.resolve_range("2024-01-12", "2024-01-18", AS_OF, R.zone(zone))
    yield day
    yield R.resolve_range(None, None, AS_OF, R.zone(zone))
    yield TimeRange(day.start_ms + 12_345, day.end_ms - 7_777_777)
    yield TimeRange(day.start_ms + 1, day.start_ms + 600_000)
    yield TimeRange(day.start_ms, day.start_ms)
    yield TimeRange(day.start_ms - 10**12, day.start_ms - 10**11)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kathmandu", "America/New_York"])
def test_figures_equal_a_scan(store, zoned, zone):
    zoned(zone)
    rows, visits, today = store.rollups(), store.visits(), R.today_range("2024-01-20", R.zone(zone))
    for span in spans(zone):
        assert tuples(rollups.daily_counts(rows, visits, span)) == tuples(aggregates.daily_counts(visits, span))
        assert tuples(rollups.result_count(rows, visits, span)) == tuples(search.result_count(visits, span))
        got = rollups.kpi_stats(rows, visits, span, today).first()
        want = aggregates.kpi_stats(visits, span, today, with_domains=True).first()
        for name in ("total_visits", "active_days", "today_visits"):
            assert got[name] == want[name]
        for name in ("unique_urls", "unique_domains"):
            assert abs(got[name] - want[name]) <= 0.05 * want[name]


def test_only_the_ends_of_a_range_are_scanned(store):
    span = next(spans("UTC"))
    whole = scanned(aggregates.daily_counts(store.visits(), span), "numOutputRows")
    visits = store.visits()
    ends = scanned(rollups._ends(visits, span, rollups.QUARTER_US).select("visit_time"))
    assert whole > 300 and ends <= 2 * len(visits.filter("visit_day = date'2024-01-18'").inputFiles())


def test_a_run_that_dies_before_its_figures_is_repaired(spark, tmp_path, monkeypatch):
    store, rng = VisitStore.create(spark, str(tmp_path)), random.Random(1)
    rows = [found(spark, rows_of(i, f"/f{i}", batch(rng, 80))) for i in range(3)]
    backup_visits(store, rows[0], as_of=AS_OF)
    for broken in ("append_rollups", "append_runs"):
        with monkeypatch.context() as patch:
            patch.setattr(VisitStore, broken, lambda *args: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                backup_visits(store, rows[1] if broken == "append_rollups" else rows[2], as_of=AS_OF)
        backup_visits(store, rows[1], as_of=AS_OF)
        everything = R.full_range(AS_OF, R.zone("UTC"))
        counts = rollups.daily_counts(store.rollups(), store.visits(), everything)
        assert tuples(counts) == tuples(aggregates.daily_counts(store.visits(), everything))
        direct = rollups.merged(store.rollups()).filter(F.col("quarter") >= 0).agg(F.sum("n_visits")).first()[0]
        assert direct == store.visits().count()


def test_api(store):
    api = History(store, as_of=AS_OF)
    with api.dashboard("2024-01-12", "2024-01-18") as panels:
        assert tuples(api.daily("2024-01-12", "2024-01-18")) == tuples(panels.daily)
        assert api.key_figures("2024-01-12", "2024-01-18").first().total_visits == panels.stats.first().total_visits
