"""The browser_history format on real SQLite files."""

import json
import sqlite3

import pytest

from helpers import ModelStore, tuples
from visitlake import fixtures
from visitlake.plans.backup import backup_files
from visitlake.plans.history import History
from visitlake.sources import history_files as H
from visitlake.sources import normalize
from visitlake.sources.store import VisitStore

US = 1705320000000000
AS_OF = "2024-01-30"


def history(path, browser, rows):
    out = fixtures.HistoryFile(str(path), browser)
    for row in rows:
        out.add(*row)
    return out.close()


def entries(n, offset=0):
    return [(f"http://h/{i % 7}", f"T{i % 7}", US + offset + i * 1_000_000, i % 9) for i in range(n)]


def load(spark, **options):
    H.register(spark)
    options = {k: json.dumps(v) if isinstance(v, list) else v for k, v in options.items()}
    return spark.read.format(H.FORMAT).options(**options).load()


@pytest.fixture
def homes(tmp_path):
    history(tmp_path / "u1" / fixtures.PROFILE_PATH["chrome"], "chrome", entries(40))
    history(tmp_path / "u1" / "snap/firefox/common/.mozilla/firefox/x/places.sqlite", "firefox", entries(30, 5))
    history(tmp_path / "u2" / fixtures.PROFILE_PATH["safari"], "safari", entries(20, 7))
    return tmp_path


def test_detected_files_are_read_and_normalised(spark, homes):
    rows = normalize.normalize_history(load(spark, homes=f"{homes}/*"))
    got = sorted(tuples(rows.select("browser", "url", "title", "visit_time", "visit_type")))
    want = [("chrome", *e) for e in entries(40)] + [("firefox", *e) for e in entries(30, 5)]
    want += [("safari", *e[:3], -1) for e in entries(20, 7)]
    assert got == sorted(want)


def test_slices_cover_a_file_exactly_once(spark, homes):
    whole = sorted(tuples(load(spark, homes=f"{homes}/*").drop("file_seq")), key=str)
    sliced = load(spark, homes=f"{homes}/*", split_bytes=1000)
    assert sliced.rdd.getNumPartitions() > 10
    assert sorted(tuples(sliced.drop("file_seq")), key=str) == whole


def test_packing_and_cutting():
    small = [(f"s{i}", 1000) for i in range(10)]
    assert len(H.plan_slices(small, 10 * H.OPEN_COST_BYTES)) == 2
    big = H.plan_slices([("big", 10_000_000)], 1_000_000)
    assert [g[0].k for g in big] == list(range(10)) and {g[0].n for g in big} == {10}
    assert H.plan_slices([], 1) == []


def test_a_slice_walks_its_row_ids_only():
    """Also where an index on the time would be at hand."""
    for layout in H.LAYOUTS:
        db = sqlite3.connect(":memory:")
        for statement in fixtures._DDL[layout.browser]:
            db.execute(statement)
        db.execute(f"CREATE INDEX by_time ON {layout.visits} ({layout.time})")
        db.execute(f"CREATE INDEX by_page ON {layout.visits} ({layout.page_key}, {layout.time})")
        steps = [row[3] for row in db.execute("EXPLAIN QUERY PLAN " + H._slice_query(layout), (1, 9, 0, 10**17))]
        assert len(steps) == 2 and all("INTEGER PRIMARY KEY" in step for step in steps)
        assert steps[0].startswith("SEARCH v")


def test_time_range_on_the_native_column(spark, homes):
    span = {"start_ms": US // 1000, "end_ms": US // 1000 + 3000}
    rows = normalize.normalize_history(load(spark, homes=f"{homes}/*", **span))
    assert sorted(r.browser for r in rows.collect()) == ["chrome"] * 4 + ["firefox"] * 3 + ["safari"] * 3


def broken(path, statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    for statement in statements:
        db.execute(statement)
    db.commit()
    db.close()
    return str(path)


def test_a_bad_file_fails_alone_and_leaves_no_rows(spark, homes, tmp_path):
    chrome = [
        "CREATE TABLE urls (id INTEGER PRIMARY KEY, url TEXT, title)",
        "CREATE TABLE visits (id INTEGER PRIMARY KEY, url INTEGER, visit_time INTEGER, transition INTEGER)",
    ]
    page = "INSERT INTO urls VALUES (1, 'http://ok/', x'ff'), (2, NULL, 'x')"
    visit = "INSERT INTO visits VALUES (%d, %d, 13349793600000000, 1)"
    bad = {
        "text": tmp_path / "bad" / "text",
        "other": broken(tmp_path / "bad" / "other", ["CREATE TABLE t (x)"]),
        "nullurl": broken(tmp_path / "bad" / "nullurl", [*chrome, page, visit % (1, 1), visit % (2000, 2)]),
        "missing": tmp_path / "bad" / "missing",
    }
    bad["text"].write_text("not a database " * 100)
    fine = broken(tmp_path / "fine", [*chrome, page, visit % (1, 1)])
    empty = broken(tmp_path / "empty", chrome)
    store = VisitStore.create(spark, str(tmp_path / "store"))
    paths = [str(p) for p in bad.values()] + [fine, empty]
    result = backup_files(store, homes=[f"{homes}/*"], paths=paths, as_of=AS_OF, split_bytes=2000)
    assert tuples(result.summary) == [(91, 91, 0, 4)]
    report = {r.data_path: r for r in result.report.collect()}
    assert {p for p, r in report.items() if r.error} == {str(p) for p in bad.values()}
    assert report[fine].found == 1 and report[empty].found == 0 and report[empty].error is None
    assert report[str(bad["nullurl"])].found == 0
    assert store.visits().filter("url = 'http://ok/'").first().title == ""
    logged = {r.data_path for r in store.import_log().collect()}
    assert fine in logged and empty not in logged and not logged & set(map(str, bad.values()))


def test_a_page_with_null_url_outside_the_range_does_no_harm(spark, tmp_path):
    path = broken(
        tmp_path / "places.sqlite",
        [
            "CREATE TABLE moz_places (id INTEGER PRIMARY KEY, url TEXT, title TEXT)",
            "CREATE TABLE moz_historyvisits (id INTEGER PRIMARY KEY, place_id, visit_date, visit_type)",
            "INSERT INTO moz_places VALUES (1, 'http://ok/', NULL), (2, NULL, 'x')",
            f"INSERT INTO moz_historyvisits VALUES (1, 1, {US}, 1), (2, 2, -5, 1)",
        ],
    )
    rows = load(spark, path=path, start_ms=0).collect()
    assert sorted((r.url, r.error) for r in rows if r.url) == [("http://ok/", None)]
    assert [r.error for r in rows if not r.url] == [None]


def test_file_order_decides(spark, tmp_path):
    a = history(tmp_path / "b" / "History", "chrome", [("u", "late file name, first in order", US, 1)])
    b = history(tmp_path / "a" / "History", "chrome", [("u", "second", US, 2)])
    store, model = VisitStore.create(spark, str(tmp_path / "store")), ModelStore()
    for path, title, kind in ((a, "late file name, first in order", 1), (b, "second", 2)):
        model.add_file(path, [("u", title, US, kind)])
    backup_files(store, paths=[a, b], as_of=AS_OF)
    columns = ("url", "title", "visit_time", "visit_type", "data_path")
    assert tuples(store.visits().select(*columns)) == model.visits()


def test_options_are_checked(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    with pytest.raises(ValueError):
        backup_files(store)
    with pytest.raises(ValueError):
        H.HistoryFileReader({})
    assert backup_files(store, homes=[f"{tmp_path}/none/*"], as_of=AS_OF).summary.first().found == 0


def test_user_facing_api(spark, homes, tmp_path):
    api = History(VisitStore.create(spark, str(tmp_path / "store")), as_of=AS_OF)
    assert tuples(api.backup(homes=[f"{homes}/*"], dry_run=True).summary) == [(90, 0, 0, 0)]
    assert tuples(api.backup(homes=[f"{homes}/*"]).summary) == [(90, 90, 0, 0)]
    size = api.store_size().first().size_bytes
    assert tuples(api.status()) == [(90, US // 1000, US // 1000 + 39_000, 3, str(tmp_path / "store"), size)]
    assert api.search().count() == 90 and api.search(keyword="H/3").count() == 6 + 4 + 3
    assert api.search(end="2024-01-14").count() == 0
    assert api.details("2024-01-15").count() == 90
    assert sorted(tuples(api.browsers())) == [("chrome", 40), ("firefox", 30), ("safari", 20)]
    assert {r.n_visits for r in api.sources().collect()} == {40, 30, 20}
    assert api.import_history().first().last_import_ms == US // 1000 + 39_000
    assert api.store_size().first().size_bytes > 1000
    with api.dashboard(keyword="h/1") as panels:
        assert panels.result_count.first().n_visits == 14
    with pytest.raises(ValueError):
        api.search(start="tomorrow")


@pytest.mark.parametrize("writable", [True, False])
def test_rows_in_the_write_ahead_log_are_read(spark, tmp_path, writable):
    home = tmp_path / "u1"
    path = home / fixtures.PROFILE_PATH["firefox"]
    out = fixtures.HistoryFile(str(path), "firefox", wal=True)
    for row in entries(21):
        out.add(*row)
    out.close()
    assert path.with_name(path.name + "-wal").stat().st_size > 0
    before = sorted(p.name for p in path.parent.iterdir())
    if not writable:
        path.parent.chmod(0o555)
    try:
        rows = normalize.normalize_history(load(spark, homes=f"{tmp_path}/*", split_bytes=1000))
        assert sorted(tuples(rows.select("url", "title", "visit_time", "visit_type"))) == sorted(entries(21))
    finally:
        path.parent.chmod(0o755)
    assert sorted(p.name for p in path.parent.iterdir()) == before


def test_files_are_listed_without_reading(spark, homes):
    api = History(VisitStore.create(spark, str(homes / "store")))
    files = {r.data_path.split("/")[-1]: r for r in api.detected([f"{homes}/u*"]).collect()}
    assert {n: (r.product, r.packaging) for n, r in files.items()} == {
        "History": ("chrome", "linux"), "places.sqlite": ("firefox", "snap-linux"), "History.db": ("safari", "macos"),
    }
    assert all(r.size_bytes > 0 for r in files.values())
    assert api.detected([f"{homes}/none*"]).count() == 0


def test_filters_become_native_bounds(spark, homes):
    from pyspark.sql import datasource as D

    low, high = US + 3_000_000, US + 9_000_000
    time, browser = ("visit_time",), ("browser",)
    filters = [D.GreaterThan(time, low - 1), D.LessThanOrEqual(time, high), D.In(browser, ("safari", "chrome"))]
    wanted = H.pushed(H.Wanted(), [*filters, D.EqualTo(browser, "safari"), D.EqualTo(("url",), "x")])
    assert (wanted.low_us, wanted.high_us, wanted.browsers) == (low, high, frozenset(["safari"]))
    chrome, firefox, safari = (wanted.native_bounds(b) for b in ("chrome", "firefox", "safari"))
    assert firefox == (low, high) and chrome == tuple(t + 11644473600 * 10**6 for t in (low, high))
    assert safari == pytest.approx(tuple(t / 1e6 - 978307200 for t in (low, high)), abs=1e-4)
    wide = H.pushed(H.Wanted(start_ms=0, end_ms=US // 1000), [D.GreaterThanOrEqual(time, 0), D.LessThan(time, 2**62)])
    assert wide.native_bounds("firefox") == (0, US // 1000 * 1000)

    reader = H.HistoryFileReader({"homes": f"{homes}/*"})
    every = [*filters, D.LessThan(time, high), D.EqualTo(time, low)]
    assert list(reader.pushFilters(every)) == every  # Spark applies them again
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist() if r["url"]]
    # Safari's bounds leave room for rounding.
    assert {(r["browser"], r["visit_time"]) for r in rows} == {("chrome", low), ("safari", low + 7)}


def test_spark_pushes_filters_into_the_source(spark, homes):
    from pyspark.sql import functions as F

    rows = load(spark, homes=f"{homes}/*").filter(
        F.col("visit_time").between(US, US + 5_000_000) & F.col("browser").isin("chrome", "safari")
    )
    got = sorted((r.browser, r.visit_time - US) for r in rows.collect())
    assert got == [("chrome", i * 1_000_000) for i in range(6)] + [("safari", 7 + i * 1_000_000) for i in range(5)]
    from helpers import scanned

    # The source itself gives no others; Spark's own filter would come later.
    assert len(got) < scanned(rows, "numOutputRows") <= len(got) + 3 + 1  # files, and rounding


def test_visit_time_is_that_of_normalised_rows(spark, homes):
    from pyspark.sql import functions as F

    raw = load(spark, homes=f"{homes}/*").filter("url IS NOT NULL")
    from visitlake.functions import scalars

    time = (
        F.when(F.col("browser") == "chrome", scalars.webkit_to_us(F.col("native_time")))
        .when(F.col("browser") == "safari", scalars.nsdate_to_us(F.col("native_seconds")))
        .otherwise(F.col("native_time"))
    )
    assert raw.filter(F.col("visit_time") != time).count() == 0 and raw.count() == 90


def test_the_driver_opens_no_home_folder(spark, tmp_path, monkeypatch):
    import glob
    import os

    n = 10_000
    for i in range(n):
        (tmp_path / "homes" / f"u{i}").mkdir(parents=True)
    for i in (3, 4_711, 9_999):
        history(tmp_path / "homes" / f"u{i}" / fixtures.PROFILE_PATH["firefox"], "firefox", entries(5, i))
    store = VisitStore.create(spark, str(tmp_path / "store"))

    def refuse(path=None, *args, **kwargs):
        raise AssertionError(f"the driver looked into {path}")

    with monkeypatch.context() as patch:
        for module, name in ((glob, "glob"), (glob, "iglob"), (os, "scandir"), (os, "listdir"), (os.path, "getsize")):
            patch.setattr(module, name, refuse)
        result = backup_files(store, homes=[f"{tmp_path}/homes/*"], as_of=AS_OF)
        assert tuples(result.summary) == [(15, 15, 0, 0)]
    assert store.visits().count() == 15


def test_listed_files_keep_the_order_of_homes_and_places(spark, homes, tmp_path):
    from visitlake.sources import detect
    from visitlake.sources.staging import Staging

    named = history(tmp_path / "named" / "History", "chrome", entries(3))
    listed = H.list_files([f"{homes}/u2", f"{homes}/*"], [named, "/missing"])
    staging = Staging(spark, "t")
    files = detect.listed_files(spark, [f"{homes}/u2", f"{homes}/*"], [named, "/missing"], staging)
    slices, n_tasks = detect.planned_slices(files, 2_000, staging)
    rows = sorted(slices.collect(), key=lambda r: (r.file_seq, r.k))
    order = list(dict.fromkeys(r.data_path for r in rows))
    assert order == list(dict.fromkeys(path for path, _ in listed)) and order[-1] == "/missing"
    assert n_tasks == len(rows) == sum(max(1, -(-size // 2_000)) for size in dict(listed).values())
    empty, n_tasks = detect.planned_slices(files.limit(0), 2_000, Staging(spark, "t"))
    assert (empty.count(), n_tasks) == (0, 1)


@pytest.fixture
def landing(tmp_path):
    """Homes with and without logs, a torn file and one that is no database."""
    history(tmp_path / "u1" / fixtures.PROFILE_PATH["chrome"], "chrome", entries(40))
    out = fixtures.HistoryFile(str(tmp_path / "u2" / fixtures.PROFILE_PATH["firefox"]), "firefox", wal=True)
    for row in entries(21, 5):
        out.add(*row)
    out.close()
    logged = tmp_path / "u3" / fixtures.PROFILE_PATH["safari"]
    history(logged, "safari", entries(20, 7))
    with sqlite3.connect(logged) as db:  # a log that is empty, as its database is closed
        db.execute("PRAGMA journal_mode=WAL")
    db.close()
    torn = tmp_path / "u4" / fixtures.PROFILE_PATH["firefox"]
    torn.parent.mkdir(parents=True)
    torn.write_bytes(b"SQLite format 3\0 torn")
    return tmp_path


def test_files_are_read_through_hadoop(spark, landing, tmp_path, monkeypatch):
    from visitlake.sources import hadoop_files
    from visitlake.sources.staging import Staging

    rows = hadoop_files.read_landing(spark, Staging(spark, "t"), [f"file://{landing}/*"])
    found = normalize.normalize_history(rows)
    want = [("chrome", *e) for e in entries(40)] + [("firefox", *e) for e in entries(21, 5)]
    want += [("safari", *e[:3], -1) for e in entries(20, 7)]
    assert sorted(tuples(found.select("browser", "url", "title", "visit_time", "visit_type"))) == sorted(want)
    status = {r.data_path.rsplit("/u", 1)[1][0]: r.error for r in rows.filter("url IS NULL").collect()}
    assert set(status) == set("1234") and [k for k, error in status.items() if error] == ["4"]

    api = History(VisitStore.create(spark, str(tmp_path / "store")), as_of=AS_OF)
    assert tuples(api.backup_landing([f"file://{landing}/*"]).summary) == [(81, 81, 0, 1)]
    assert tuples(api.backup_landing(paths=[f"file://{landing}/u1/.config/google-chrome/Default/History"]).summary) == [(40, 0, 40, 0)]
    assert tuples(api.backup_landing(["file:///none/*"]).summary) == [(0, 0, 0, 0)]

    monkeypatch.setattr(hadoop_files, "MOST_BYTES", 9_000)
    rows = hadoop_files.read_landing(spark, Staging(spark, "t"), [f"file://{landing}/*"])
    errors = {r.error for r in rows.filter("error IS NOT NULL").collect()}
    assert any(e == hadoop_files._TOO_LARGE for e in errors)


def test_queries_write_their_files_where_a_uri_says(spark, tmp_path, monkeypatch):
    """The shared folder may be named by a ``file:`` URI, which SQLite does not open."""
    import __spark_entry__ as entry

    events = [(i, i % 4, f"2024-01-{1 + i % 28:02d} 08:00:{i:02d}") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").selectExpr(
        "event_id", "user_id", "cast(ts AS timestamp_ntz) AS ts"
    ).write.parquet(f"{tmp_path}/sf/events.parquet")
    pages = [(i, f"http://h{i}.example/", f"<title>T{i}</title>") for i in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    monkeypatch.setattr(entry.staging, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    queries = entry.queries()
    want = None
    for name in ("history_file_scan", "history_landing_scan", "streaming_file_backup"):
        rows = sorted(map(str, queries[name](spark, f"{tmp_path}/sf").collect()))
        assert len(rows) == 40 and (want or rows) == rows, name
        want = rows
    assert queries["detected_files"](spark, f"{tmp_path}/sf").count() == 3


def test_scans_read_their_files_where_a_uri_says(spark, tmp_path, monkeypatch):
    """The same for files dealt by tasks, under filters and with a write-ahead log."""
    import __spark_entry__ as entry

    events = [(i, i % 4, f"2024-01-{1 + i % 28:02d} 08:00:{i:02d}") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").selectExpr(
        "event_id", "user_id", "cast(ts AS timestamp_ntz) AS ts"
    ).write.parquet(f"{tmp_path}/sf/events.parquet")
    pages = [(i, f"http://h{i}.example/", f"<title>T{i}</title>") for i in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    monkeypatch.setattr(entry.staging, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    found = {}
    for name in ("history_planned_scan", "history_wal_scan", "history_pushed_scan"):
        found[name] = sorted(map(tuple, entry.queries()[name](spark, f"{tmp_path}/sf").collect()), key=str)
    every = found["history_planned_scan"]
    assert len(every) == 40 and every == found["history_wal_scan"]
    week = [r for r in every if entry.WEEK.start_us <= r[2] <= entry.WEEK.end_us and r[4] != "firefox"]
    assert week and week == found["history_pushed_scan"]


def test_queries_write_their_files_from_tables_with_nulls(spark, tmp_path):
    """Visits without time are in no range; those without url fail a file of their own."""
    import __spark_entry__ as entry

    events = [
        (i, None if i % 9 == 4 else i % 5, None if i % 7 == 3 else f"2024-01-{1 + i % 28:02d} 08:00:{i:02d}")
        for i in range(40)
    ]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").selectExpr(
        "event_id", "user_id", "cast(ts AS timestamp_ntz) AS ts"
    ).write.parquet(f"{tmp_path}/sf/events.parquet")
    pages = [(i, None if i == 2 else f"http://h{i}.example/", f"<title>T{i}</title>") for i in range(6)]
    pages = [(i, url, None if i == 5 else html) for i, url, html in pages]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    sf = f"{tmp_path}/sf"
    visits = [tuple(r) for r in fixtures.found_visits(spark, sf).select("url", "visit_time", "browser").collect()]
    want = sorted((r for r in visits if None not in r), key=str)
    assert 0 < len(want) < len([r for r in visits if r[0]]) < len(visits)
    queries = entry.queries()
    every = (
        "history_file_scan history_wal_scan history_planned_scan history_landing_scan streaming_file_backup"
        " streaming_history_source"
    )
    for name in every.split():
        found = queries[name](spark, sf).select("url", "visit_time", "browser").collect()
        assert sorted(map(tuple, found), key=str) == want, name
    week = [r for r in want if entry.WEEK.start_us <= r[1] <= entry.WEEK.end_us and r[2] != "firefox"]
    found = queries["history_pushed_scan"](spark, sf).select("url", "visit_time", "browser").collect()
    assert week and sorted(map(tuple, found), key=str) == week
    assert queries["detected_files"](spark, sf).count() == 3
    runs = {r["run"]: r for r in queries["backup_files_twice"](spark, sf).collect()}
    assert (runs["first"]["found"], runs["first"]["imported"]) == (len(want), len(want))
    assert (runs["again"]["found"], runs["again"]["duplicated"]) == (len(want), len(want))
    assert runs["first"]["failed"] == runs["again"]["failed"] > 1


def test_a_file_is_written_again_after_an_attempt_that_stopped(tmp_path):
    path = str(tmp_path / "History")
    stopped = fixtures.HistoryFile(path, "chrome")
    stopped.add("http://a/", "A", 1, 0)
    stopped.db.close()
    again = fixtures.HistoryFile(path, "chrome")
    again.add("http://b/", "B", 2, 0)
    again.close()
    rows = [r for b in H.read_slice(H.FileSlice(path, 0, 0, 1), H.Wanted()) for r in b.to_pylist()]
    assert [r["url"] for r in rows] == ["http://b/"]
