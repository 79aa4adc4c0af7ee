from helpers import DAY_US, NOON, tuples, visits
from visitlake.functions import ranges as R
from visitlake.operators import aggregates as A
from visitlake.operators import ingest, search
from visitlake.plans.dashboard import dashboard
from visitlake.functions.ranges import TimeRange

UTC = R.zone("UTC")
EVER = TimeRange(0, 2**42)
MIDNIGHT = NOON - DAY_US // 2


def test_search_order_titles_and_types(spark):
    v = visits(spark, [("b", None, 2000, 3), ("a", "A", 2000, 1), ("c", "", 1999, 9)])
    assert tuples(search.search_visits(v, EVER)) == [("c", "", 1, 9), ("a", "A", 2, 1), ("b", "", 2, 3)]
    assert [r[3] for r in tuples(search.search_visits(v, EVER, compat=True))] == [0, 0, 0]
    assert [r[0] for r in tuples(search.search_visits(v, EVER, limit=2))] == ["c", "a"]


def test_range_end_loses_its_last_microseconds(spark):
    v = visits(spark, [("u", "t", MIDNIGHT + DAY_US - 1000 + 500, 0), ("u", "t", MIDNIGHT + DAY_US - 1000, 0)])
    span = R.resolve_range("2024-01-15", "2024-01-15", None, UTC)
    assert len(tuples(search.search_visits(v, span))) == 1


def test_day_details_reach_the_next_midnight(spark):
    v = visits(spark, [("u", "", MIDNIGHT + DAY_US, 0), ("w", "t", MIDNIGHT + DAY_US + 1, 0)])
    assert tuples(search.day_details(v, "2024-01-15", UTC)) == [(1705363200000, "00:00:00", "u", "u", "", 0)]


def test_domains_exact_and_compat(spark):
    rows = []
    for url, n in (("http://h/a", 5), ("http://h/b", 3), ("http://h/c", 2), ("http://g/", 10)):
        rows += [(url, "t", NOON + len(rows) + i, 0) for i in range(n)]
    v = visits(spark, rows)
    assert tuples(A.top_domains(v, EVER)) == [("g", 10), ("h", 10)]
    assert tuples(A.top_domains(v, EVER, compat=True)) == [("g", 20), ("h", 15)]
    assert tuples(A.top_domains(v, EVER, k=1)) == [("g", 10)]
    assert tuples(A.url_counts(v, EVER, k=2)) == [("http://g/", 10), ("http://h/a", 5)]


def test_blank_titles_stay_out_of_top_lists_only(spark):
    v = visits(spark, [("http://a/", None, NOON, 0), ("http://a/", "", NOON + 1, 0), ("http://b/", "B", NOON + 2, 0)])
    assert tuples(A.top_titles(v, EVER)) == [("B", 1)]
    assert tuples(A.top_domains(v, EVER)) == [("b", 1)]
    assert tuples(A.url_counts(v, EVER)) == [("http://b/", 1)]
    assert tuples(A.daily_counts(v, EVER)) == [(1705276800000, 3)]
    assert tuples(search.result_count(v, EVER)) == [(3,)]
    assert tuples(search.result_count(v, EVER, "A/")) == [(2,)]


def test_daily_counts_follow_the_session_zone(spark, zoned):
    v = visits(spark, [("u", "t", 1705276799999999, 0), ("u", "t", NOON, 0)])
    zoned("Asia/Shanghai")
    assert tuples(A.daily_counts(v, EVER)) == [(1705248000000, 2)]
    zoned("America/New_York")
    assert tuples(A.daily_counts(v, EVER)) == [(1705208400000, 1), (1705294800000, 1)]


def test_time_span_and_status(spark):
    v = visits(spark, [("u", "t", 5999, 0), ("u", "t", 1999, 0)])
    none = v.limit(0)
    log = spark.createDataFrame([("/p", 5999, 0)], "data_path string, last_import bigint, run_seq bigint")
    latest = ingest.latest_imports(log)
    assert tuples(A.time_span(v)) == [(1, 5)]
    assert tuples(A.time_span(none)) == [(None, None)]
    assert tuples(A.time_span(none, fallback=TimeRange(0, 77))) == [(0, 77)]
    assert tuples(A.store_status(v, latest)) == [(2, 1, 5, 1)]
    assert tuples(A.store_status(none, latest.limit(0))) == [(0, 0, 0, 0)]
    assert tuples(A.import_history(latest)) == [("/p", 5)]


def test_key_figures(spark):
    v = visits(
        spark,
        [
            ("http://a/1", "t", NOON, 0),
            ("http://a/2", "t", NOON + DAY_US, 0),
            ("http://a/2", "t", NOON + DAY_US + 1, 0),
            ("http://b/", "t", NOON + 9 * DAY_US, 0),
        ],
    )
    span = R.resolve_range("2024-01-15", "2024-01-16", None, UTC)
    today = R.today_range("2024-01-24", UTC)
    assert tuples(A.kpi_stats(v, span, today, with_domains=True)) == [(3, 2, 2, 1, 1)]
    assert tuples(A.kpi_stats(v, span, today, approx=True)) == [(3, 2, 2, 1)]
    assert tuples(A.kpi_stats(v, span, today, approx=True, with_domains=True)) == [(3, 2, 2, 1, 1)]
    assert tuples(A.kpi_stats(v.limit(0), span, today)) == [(0, 0, 0, 0)]
    assert tuples(A.kpi_stats(v.limit(0), span, today, with_domains=True)) == [(0, 0, 0, 0, 0)]


def test_share_of_top(spark):
    top = spark.createDataFrame([(f"n{i:02}", 10 if i < 9 else 5) for i in range(12)], "title string, cnt bigint")
    rows = tuples(A.share_of_top(top, "title"))
    assert len(rows) == 10 and rows[0] == ("n00", "n00", 10, 10.53) and rows[-1][2:] == (5, 5.26)


def test_breakdowns(spark):
    v = visits(
        spark,
        [("a", "", 1, 0, "chrome", "/x"), ("b", "", 2, 0, "safari", "/x"), ("c", "", 3, 0, "chrome", "/y")],
    )
    assert sorted(tuples(A.browser_breakdown(v))) == [("chrome", 2), ("safari", 1)]
    imports = spark.createDataFrame([("/x", 2000), ("/z", 9000)], "data_path string, last_import bigint")
    assert sorted(tuples(A.source_record_counts(v, imports))) == [("/x", 2, 2), ("/z", 9, 0)]


def test_dashboard_panels_equal_the_single_queries(spark):
    rows = [(f"http://h{i % 7}/{i % 13}", None if i % 5 == 0 else f"T{i % 4}", NOON + i * DAY_US // 9, 0) for i in range(200)]
    v = visits(spark, rows)
    span = R.resolve_range("2024-01-16", "2024-02-05", None, UTC)
    for keyword, compat, keep in ((None, False, True), ("H3", False, True), ("t_", True, False)):
        with dashboard(v, span, "2024-02-01", UTC, keyword, compat=compat, keep_counts=keep) as panels:
            assert (panels.cells is not None) == (keyword == "H3")
            assert tuples(panels.daily) == tuples(A.daily_counts(v, span, keyword))
            assert tuples(panels.titles) == tuples(A.top_titles(v, span, keyword))
            assert tuples(panels.domains) == tuples(A.top_domains(v, span, keyword, compat=compat))
            assert tuples(panels.result_count) == tuples(search.result_count(v, span, keyword))
            assert tuples(panels.stats) == tuples(A.kpi_stats(v, span, R.today_range("2024-02-01", UTC)))
            assert tuples(panels.span) == tuples(A.time_span(v))


def test_case_sensitive_panels(spark):
    v = visits(spark, [("http://a/The", "x", NOON, 0), ("http://b/the", "y", NOON, 0), ("http://c/", "The", NOON + 1, 0)])
    span = R.resolve_range("2024-01-15", "2024-01-16", None, UTC)
    for sensitive, n in ((True, 2), (False, 3)):
        assert tuples(search.result_count(v, span, "The", sensitive)) == [(n,)]
        assert [r.cnt for r in A.daily_counts(v, span, "The", sensitive).collect()] == [n]
        assert A.top_titles(v, span, "The", case_sensitive=sensitive).count() == n
        assert A.url_counts(v, span, "The", case_sensitive=sensitive).count() == n
        assert A.top_domains(v, span, "The", case_sensitive=sensitive).count() == n
        assert search.day_details(v, "2024-01-15", UTC, "The", sensitive).count() == n
        with dashboard(v, span, "2024-01-16", UTC, "The", case_sensitive=sensitive) as panels:
            assert tuples(panels.result_count) == [(n,)] and panels.domains.count() == n
