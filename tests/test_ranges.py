from datetime import datetime

import pytest

from visitlake.functions import ranges as R

UTC = R.zone("UTC")


def test_default_window():
    span = R.resolve_range(None, None, "2024-01-30", UTC)
    assert span.end_ms == R.midnight_ms("2024-01-31", UTC) - 1
    assert span.start_ms == R.midnight_ms("2024-01-01", UTC)


def test_given_days_are_whole_days():
    span = R.resolve_range("2024-1-5", "2024-01-06", None, UTC)
    assert span == R.TimeRange(1704412800000, 1704585599999)


@pytest.mark.parametrize("bad", ["", "2024-13-01", "2024-02-30", "yesterday", "2024/01/01", "2024-01-01T00"])
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        R.resolve_range(bad, None, "2024-01-30", UTC)


def test_day_includes_next_midnight():
    span = R.day_range("2024-01-10", UTC)
    assert span.end_ms == R.midnight_ms("2024-01-11", UTC)


def test_zones():
    assert R.midnight_ms("2024-01-15", R.zone("Asia/Shanghai")) == 1705248000000
    assert R.midnight_ms("2024-01-15", R.zone("+08:00")) == 1705248000000
    assert R.midnight_ms("2024-01-15", R.zone("GMT-3")) == 1705287600000


def test_skipped_midnight_moves_forward(spark, zoned):
    name = "America/Sao_Paulo"  # 2018-11-04 began at 01:00
    zoned(name)
    ours = R.midnight_ms("2018-11-04", R.zone(name))
    assert ours == spark.sql("SELECT unix_millis(timestamp'2018-11-04 00:00:00')").first()[0]


def test_as_of_takes_moments_and_days():
    moment = datetime(2024, 1, 30, 23, 30, tzinfo=UTC)
    assert R.tomorrow_ms(moment, R.zone("Asia/Shanghai")) == R.midnight_ms("2024-02-01", R.zone("Asia/Shanghai"))
    assert R.tomorrow_ms(moment, UTC) == R.tomorrow_ms("2024-01-30", UTC)
    assert R.today_range("2024-01-30", UTC) == R.TimeRange(1706572800000, 1706659199999)
    assert R.tomorrow_ms(None, UTC) % 86_400_000 == 0


def test_native_bounds():
    span = R.TimeRange(0, 1705320000000)
    assert span.native_bounds("firefox") == (0, 1705320000000000)
    assert span.native_bounds("chrome") == (11644473600000000, 13349793600000000)
    assert span.native_bounds("safari") == (-978307200.0, 727012800.0)
    with pytest.raises(ValueError):
        span.native_bounds("lynx")


def test_utc_days_of_extreme_bounds():
    assert [str(d) for d in R.TimeRange(-1, 2**53).utc_days] == ["1969-12-31", "9999-12-31"]
