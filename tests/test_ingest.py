"""Ingest steps and whole backups against a row-by-row model."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import DAY_US, NOON, ModelStore, found, tuples
from visitlake.functions.ranges import TimeRange
from visitlake.operators import ingest
from visitlake.plans import backup
from visitlake.plans.backup import backup_visits
from visitlake.sources.store import VisitStore

AS_OF = "2024-01-30"


def rows_of(file_seq, path, entries):
    ordered = sorted(enumerate(entries), key=lambda e: e[1][2])
    return [(u, t, when, kind, "chrome", path, file_seq, i) for i, (u, t, when, kind) in ordered]


def random_file(rng, n):
    """Entries whose times are unique inside the file, as in a real one."""
    times = rng.sample(range(60), n)
    return [
        (f"http://h/{rng.randrange(6)}", rng.choice(["", "A", "B", "C"]), NOON + t * DAY_US // 20, rng.randrange(9))
        for t in times
    ]


def stored(store):
    columns = ("url", "title", "visit_time", "visit_type", "data_path")
    return sorted(tuples(store.visits().select(*columns)))


@pytest.mark.parametrize(("seed", "broadcast_limit"), [(1, 0), (2, 1 << 20), (3, 0)])
def test_backups_equal_the_model(spark, tmp_path, monkeypatch, seed, broadcast_limit):
    monkeypatch.setattr(ingest, "MAX_BROADCAST_HASHES", broadcast_limit)
    rng = random.Random(seed)
    store, model = VisitStore.create(spark, str(tmp_path)), ModelStore()
    imported = duplicated = 0
    for run in range(3):
        batch = []
        for seq in range(4):
            path = f"/f{rng.randrange(6)}-{run % 2}-{seq}"
            entries = random_file(rng, 25)
            model.add_file(path, entries)
            batch += rows_of(seq, path, entries)
        rng.shuffle(batch)
        result = backup_visits(store, found(spark, batch).repartition(rng.randrange(1, 7)), as_of=AS_OF)
        summary = result.summary.first()
        assert summary.found == 100 and summary.failed == 0
        imported += summary.imported
        duplicated += summary.duplicated
    assert stored(store) == model.visits()
    assert (imported, duplicated) == (model.imported, model.duplicated)
    latest = ingest.latest_imports(store.import_log())
    assert sorted(tuples(latest.select("data_path", "last_import"))) == model.imports()
    urls = sorted(tuples(store.urls()))
    assert urls == sorted(model.db.execute("SELECT url, title FROM pages"))


def test_second_run_imports_nothing(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    batch = found(spark, rows_of(0, "/a", random_file(random.Random(0), 30)))
    assert tuples(backup_visits(store, batch, as_of=AS_OF).summary) == [(30, 30, 0, 0)]
    before = stored(store)
    again = backup_visits(store, batch, as_of=AS_OF)
    assert again.run_seq == 1
    assert tuples(again.summary) == [(30, 0, 30, 0)]
    assert stored(store) == before
    assert store.urls().count() == store.urls().distinct().count()


def test_first_title_wins_even_when_blank(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    first = rows_of(0, "/a", [("u", "", NOON, 0), ("u", "T", NOON + 1, 0)])
    backup_visits(store, found(spark, first), as_of=AS_OF)
    backup_visits(store, found(spark, rows_of(0, "/b", [("u", "Z", NOON - 5, 0)])), as_of=AS_OF)
    assert {r[1] for r in stored(store)} == {""}


def test_first_visit_type_wins(spark):
    rows = [("u", "", NOON, 103, "chrome", "/b", 7, 1), ("u", "", NOON, 3, "safari", "/a", 2, 9)]
    kept = ingest.dedup_visits(found(spark, rows))
    assert [(r.visit_type, r.browser) for r in kept.collect()] == [(3, "safari")]


def test_last_import_may_go_down(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    backup_visits(store, found(spark, rows_of(0, "/a", [("u", "", 200, 0)])), as_of=AS_OF)
    backup_visits(store, found(spark, rows_of(0, "/a", [("u", "", 150, 0)])), as_of=AS_OF)
    assert tuples(ingest.latest_imports(store.import_log())) == [("/a", 150)]


def test_only_the_accepted_range(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    tomorrow = 1_706_659_200_000_000
    times = (-1, 0, tomorrow, tomorrow + 1)
    entries = [(f"u{i}", "", t, 0) for i, t in enumerate(times)]
    result = backup_visits(store, found(spark, rows_of(0, "/a", entries)), as_of=AS_OF)
    assert tuples(result.summary) == [(2, 2, 0, 0)]
    assert [r[2] for r in stored(store)] == [0, tomorrow]


def test_dry_run_and_preview_write_nothing(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    old = found(spark, rows_of(0, "/a", [("u", "", NOON, 0)]))
    new = found(spark, rows_of(0, "/b", [("u", "", NOON, 0), ("w", "", NOON, 0), ("x", "", NOON, 0)]))
    backup_visits(store, old, as_of=AS_OF)
    dry = backup_visits(store, new, as_of=AS_OF, dry_run=True)
    assert tuples(dry.summary) == [(3, 0, 0, 0)]
    preview = backup_visits(store, new, as_of=AS_OF, dry_run=True, preview=True)
    assert tuples(preview.report) == [("/b", 3, 2, 1, NOON, None)]
    dry.close()
    preview.close()
    assert store.visits().count() == 1 and store.import_log().count() == 1


def test_report_credits_the_first_file(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path))
    batch = rows_of(0, "/a", [("u", "", NOON, 0)]) + rows_of(1, "/b", [("u", "", NOON, 0), ("w", "", NOON, 0)])
    result = backup_visits(store, found(spark, batch), as_of=AS_OF)
    assert sorted(tuples(result.report)) == [("/a", 1, 1, 0, NOON, None), ("/b", 2, 1, 1, NOON, None)]


def test_interrupted_run_is_repaired_by_the_next(spark, tmp_path, monkeypatch):
    store = VisitStore.create(spark, str(tmp_path))
    batch = found(spark, rows_of(0, "/a", random_file(random.Random(5), 30)))
    monkeypatch.setattr(VisitStore, "append_visits", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        backup_visits(store, batch, as_of=AS_OF)
    monkeypatch.undo()
    model = ModelStore()
    model.add_file("/a", [r[:4] for r in random_file(random.Random(5), 30)])
    assert tuples(backup_visits(store, batch, as_of=AS_OF).summary) == [(30, 30, 0, 0)]
    assert stored(store) == model.visits()
    assert store.urls().groupBy("url").count().filter("count > 1").count() == 0


def test_many_days_fall_back_to_a_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backup, "MAX_LISTED_DAYS", 1)
    store = VisitStore.create(spark, str(tmp_path))
    entries = [("u", "", NOON - i * DAY_US, 0) for i in range(5)]
    for expected in ((5, 5, 0, 0), (5, 0, 5, 0)):
        result = backup_visits(store, found(spark, rows_of(0, "/a", entries)), as_of=AS_OF)
        assert tuples(result.summary) == [expected]


def test_one_hot_url_and_one_hot_visit(spark, tmp_path):
    """A third of the rows is one url, another third copies of one visit."""
    hot = spark.range(3000).select(
        F.lit("hot").alias("url"), F.lit("H").alias("title"), (F.lit(NOON) + F.col("id")).alias("visit_time"),
        F.lit(1).cast("bigint").alias("visit_type"), F.lit("chrome").alias("browser"),
        F.lit("/hot").alias("data_path"), F.lit(0).cast("bigint").alias("file_seq"), F.col("id").alias("src_row"),
    )
    copies = hot.withColumns(
        {"url": F.lit("copy"), "visit_time": F.lit(NOON), "file_seq": F.col("src_row") + 1,
         "data_path": F.concat(F.lit("/c"), F.col("src_row") % 50), "visit_type": F.col("src_row")}
    )
    rest = hot.withColumns({"url": F.concat(F.lit("u"), F.col("src_row")), "data_path": F.lit("/rest")})
    store = VisitStore.create(spark, str(tmp_path))
    result = backup_visits(store, hot.unionByName(copies).unionByName(rest), as_of=AS_OF)
    assert tuples(result.summary) == [(9000, 6001, 2999, 0)]
    assert tuples(store.visits().filter("url = 'copy'").select("visit_type")) == [(0,)]


def test_accepted_bounds_are_inclusive(spark):
    rows = found(spark, rows_of(0, "/a", [("u", "", t, 0) for t in (999, 1000, 2000, 2001)]))
    kept = ingest.accepted_visits(rows, TimeRange(1, 2))
    assert sorted(r.visit_time for r in kept.collect()) == [1000, 2000]


def test_a_landed_visit_without_url_fails_its_file(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    rows = rows_of(0, "/good", [("u", "t", NOON, 1)]) + rows_of(1, "/bad", [("w", "t", NOON, 1), (None, "t", NOON, 1)])
    for turn in range(2):
        run = backup_visits(store, found(spark, rows), as_of="2024-01-30", stage_input=turn == 0)
        (summary,) = tuples(run.summary)
        assert summary == (1, 1 - turn, turn, 1)
    assert tuples(store.visits().select("url")) == [("u",)]
    assert store.urls().count() == 1
