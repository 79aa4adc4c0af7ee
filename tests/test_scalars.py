import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitlake.functions import scalars as S
from visitlake.sources import profiles


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://emacs-china.org/", "emacs-china.org"),
        ("https://github.com/notifications", "github.com"),
        ("data:text/html", "data:text/html"),
        ("https://nohost", "https://nohost"),
        ("file:///home/user/x", "/home"),
        ("http://h?u=https://z/", "h?u=https:"),
        ("https://a\u2028b/c", "a\u2028b"),
        ("https://me:pw@h.example:8080/x", "me:pw@h.example:8080"),
        ("http://a\nb/://c/", "c"),
        ("", ""),
    ],
)
def test_domain(spark, url, domain):
    assert value(spark, S.domain_of(F.lit(url))) == domain


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(urls=st.lists(st.text("a:/\n\r\u2028é.", max_size=14), min_size=50, max_size=100))
def test_domain_of_odd_urls(spark, urls):
    def expected(url):
        hit = re.search("://(.+?)/", url)
        return hit.group(1) if hit else url

    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in frame.select(S.domain_of(F.col("u"))).collect()] == [expected(u) for u in urls]


def test_one_instant_in_every_encoding(spark):
    us = F.lit(1705320000000000)
    assert value(spark, S.us_to_ms(us)) == 1705320000000
    assert value(spark, S.ms_to_us(F.lit(1705320000000))) == 1705320000000000
    assert value(spark, S.us_to_webkit(us)) == 13349793600000000
    assert value(spark, S.webkit_to_us(F.lit(13349793600000000))) == 1705320000000000
    assert value(spark, S.us_to_nsdate(us)) == 727012800.0
    assert value(spark, S.nsdate_to_us(F.lit(727012800.0))) == 1705320000000000


def test_truncation(spark):
    assert value(spark, S.nsdate_to_us(F.lit(0.0000019))) == 978307200000001
    assert value(spark, S.us_to_ms(F.lit(1999))) == 1
    assert value(spark, S.us_to_ms(F.lit(-1999))) == -1


def test_days_by_zone(spark, zoned):
    late = F.lit(1705276799999999)
    zoned("Asia/Shanghai")
    assert str(value(spark, S.utc_day(late))) == "2024-01-14"
    assert str(value(spark, S.local_day(late))) == "2024-01-15"
    midnight = value(spark, S.ymd_to_ms(F.lit("2022-01-15")))
    assert midnight == 1642176000000
    assert value(spark, S.ms_to_ymd(F.lit(midnight))) == "2022-01-15"
    assert value(spark, S.day_start_ms(F.lit("2022-01-15").cast("date"))) == midnight


def test_calendar_text(spark):
    ms = F.lit(1705276799999)
    assert value(spark, S.ms_to_hms(ms)) == "23:59:59"
    assert value(spark, S.ms_to_ymdhms(ms)) == "2024-01-14 23:59:59"
    assert value(spark, S.previous_ymd(ms)) == "2024-01-13"
    assert value(spark, S.next_ymd(ms)) == "2024-01-15"
    assert value(spark, S.ymd_to_ms(F.lit("2024-1-5"))) == 1704412800000


def test_labels(spark):
    null = F.lit(None).cast("string")
    assert value(spark, S.display_title(null, F.lit("u"))) == "u"
    assert value(spark, S.display_title(F.lit(""), F.lit("u"))) == "u"
    assert value(spark, S.display_title(F.lit("t"), F.lit("u"))) == "t"
    assert value(spark, S.short_label(F.lit("x" * 50))) == "x" * 50
    assert value(spark, S.short_label(F.lit("ü" * 51))) == "ü" * 50 + "…"
    assert value(spark, S.size_label(F.lit(1023))) == "1023 B"
    assert value(spark, S.size_label(F.lit(1024))) == "1.0 KB"
    assert value(spark, S.size_label(F.lit(5 * 1024 * 1024 + 104858))) == "5.10 MB"
    assert value(spark, S.time_label(F.lit(0))) == "—"
    assert value(spark, S.time_label(F.lit(1705320000000))) == "2024-01-15 12:00:00"


def test_visit_type_labels(spark):
    def label(browser, code):
        return value(spark, S.visit_type_label(F.lit(browser), F.lit(code).cast("bigint")))

    assert label("firefox", 7) == "download"
    assert label("chrome", 7) == "form submit"
    assert label("chrome", 5) is None
    assert label("safari", -1) is None
    assert label("firefox", 2**40) is None


def test_products(spark):
    cases = {
        "/h/u/.config/google-chrome/Profile 1/History": ("chrome", "linux"),
        "/h/u/.var/app/com.google.Chrome/config/google-chrome/Default/History": ("chrome", "flatpak-linux"),
        "/h/u/snap/firefox/common/.mozilla/firefox/x.default/places.sqlite": ("firefox", "snap-linux"),
        "/h/u/.mozilla/firefox/x.default/places.sqlite": ("firefox", "linux"),
        "/h/u/Library/Application Support/BraveSoftware/Brave-Browser/Default/History": ("brave", "macos"),
        "/h/u/AppData/Local/Google/Chrome/User Data/Default/History": ("chrome", "windows"),
        "Library/Safari/History.db": ("safari", "macos"),
        "/h/u/.config/microsoft-edge/Default/History": ("edge", "linux"),
        "/h/u/.config/chromium/a/b/History": (None, None),
        "/tmp/History": (None, None),
    }
    frame = spark.createDataFrame([(p,) for p in cases], "p string").select(
        "p", profiles.product_of(F.col("p")), profiles.packaging_of(F.col("p"))
    )
    assert {r[0]: (r[1], r[2]) for r in frame.collect()} == cases
