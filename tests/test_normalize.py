import pytest

from helpers import tuples
from visitlake.functions.ranges import TimeRange
from visitlake.sources import normalize as N

US = 1705320000000000
WEBKIT = 13349793600000000
NSDATE = 727012800.0


def chrome(spark):
    visits = spark.createDataFrame(
        [(1, 1, WEBKIT, 805306368, "/a", 0), (2, 2, WEBKIT + 1, -5, "/a", 0), (3, 1, WEBKIT + 2, 7, "/b", 1), (4, 9, WEBKIT, 0, "/a", 0)],
        "id bigint, url bigint, visit_time bigint, transition bigint, data_path string, file_seq int",
    )
    urls = spark.createDataFrame(
        [(1, "http://a", None, "/a"), (2, "http://b", "B", "/a"), (1, "http://c", "C", "/b")],
        "id bigint, url string, title string, data_path string",
    )
    return visits, urls


def firefox(spark):
    visits = spark.createDataFrame(
        [(1, 5, US, 3, "/f", 2)], "id bigint, place_id bigint, visit_date bigint, visit_type bigint, data_path string, file_seq int"
    )
    places = spark.createDataFrame([(5, "http://f", "F", "/f")], "id bigint, url string, title string, data_path string")
    return visits, places


def safari(spark):
    visits = spark.createDataFrame(
        [(1, 8, NSDATE, None, "/s", 3)], "id bigint, history_item bigint, visit_time double, title string, data_path string, file_seq int"
    )
    items = spark.createDataFrame([(8, "http://s", "/s")], "id bigint, url string, data_path string")
    return visits, items


def test_chrome_ids_belong_to_their_file(spark):
    rows = sorted(tuples(N.normalize_chrome(*chrome(spark))))
    assert rows == [
        ("http://a", "", US, 0, "chrome", "/a", 0, 1),
        ("http://b", "B", US + 1, 251, "chrome", "/a", 0, 2),
        ("http://c", "C", US + 2, 7, "chrome", "/b", 1, 3),
    ]


def test_landed_pairs_are_told_by_their_columns(spark):
    pairs = [safari(spark), chrome(spark), firefox(spark)]
    assert [N.landed_browser(v) for v, _ in pairs] == ["safari", "chrome", "firefox"]
    rows = N.normalize_landed(pairs)
    assert sorted(r.browser for r in rows.collect()) == ["chrome"] * 3 + ["firefox", "safari"]
    assert ("http://s", "", US, -1, "safari", "/s", 3, 1) in tuples(rows)
    assert ("http://f", "F", US, 3, "firefox", "/f", 2, 1) in tuples(rows)
    with pytest.raises(ValueError):
        N.landed_browser(["id", "when"])


def test_native_range_is_inclusive(spark):
    at = TimeRange(US // 1000, US // 1000)
    assert N.normalize_firefox(*firefox(spark), at).count() == 1
    assert N.normalize_safari(*safari(spark), at).count() == 1
    assert N.normalize_chrome(*chrome(spark), at).count() == 1
    later = TimeRange(US // 1000 + 1, US // 1000 + 2)
    assert N.normalize_landed([firefox(spark), safari(spark), chrome(spark)], later).count() == 0
