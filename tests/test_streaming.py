import os
import random
import time

import pytest

from helpers import NOON, ModelStore, found, tuples
from test_history_files import entries, history
from test_ingest import random_file, rows_of, stored
from visitlake import fixtures, schema
from visitlake.plans.backup import backup_files, backup_visits
from visitlake.sources import history_files as H
from visitlake.sources.store import VisitStore
from visitlake.streaming.incremental import (
    backup_failed,
    backup_file_stream,
    backup_history_stream,
    backup_visit_stream,
    failed_files,
    local_path,
)
from visitlake.streaming.progress import Progress

AS_OF = "2024-01-30"


def test_streamed_result_equals_the_batch_result(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    model, rng, whole = ModelStore(), random.Random(9), []
    landing = str(tmp_path / "landing")
    for seq in range(3):
        rows = random_file(rng, 20)
        model.add_file(f"/f{seq}", rows)
        batch = rows_of(seq, f"/f{seq}", rows)
        whole += batch
        found(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema.FOUND_VISITS).parquet(landing)
        query = backup_visit_stream(store, stream, str(tmp_path / "ck"), as_of=AS_OF)
        query.awaitTermination()
        assert query.exception() is None
    assert stored(store) == model.visits()
    other = VisitStore.create(spark, str(tmp_path / "other"))
    backup_visits(other, found(spark, whole), as_of=AS_OF)
    assert stored(other) == stored(store)


def test_history_files_are_taken_as_they_land(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    landing = tmp_path / "land ing"

    def run():
        query = backup_file_stream(store, str(landing), str(tmp_path / "ck"), as_of=AS_OF, max_files=2)
        query.awaitTermination()
        return store.visits().count()

    for day in range(3):
        history(landing / f"d{day}" / "History", "chrome", entries(10, day))
        (landing / f"d{day}" / "History-journal").write_bytes(b"x")
    assert run() == 30
    assert run() == 30
    history(landing / "d9" / "places.sqlite", "firefox", entries(10, 0) + entries(5, 77))
    assert run() == 35
    last = store.import_runs().orderBy("run_seq", ascending=False).first()
    assert (last.found, last.imported, last.duplicated, last.error) == (15, 5, 10, None)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    batch = found(spark, rows_of(0, "/a", [("u", "t", NOON, 1)]))
    batch.write.parquet(str(tmp_path / "landing"))
    stream = spark.readStream.schema(schema.FOUND_VISITS).parquet(str(tmp_path / "landing"))
    for checkpoint in ("ck1", "ck2"):  # a new checkpoint replays everything
        backup_visit_stream(store, stream, str(tmp_path / checkpoint), as_of=AS_OF).awaitTermination()
    assert tuples(store.visits().select("url", "visit_type")) == [("u", 1)]


def test_paths_are_taken_as_they_are(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    for i, name in enumerate(("plain", "a#b", "c?d", "a%20b", "e f")):
        history(tmp_path / "land" / name / "History", "chrome", entries(4, i))
    backup_file_stream(store, str(tmp_path / "land"), str(tmp_path / "ck"), as_of=AS_OF).awaitTermination()
    assert store.import_runs().filter("error IS NOT NULL").count() == 0
    assert store.visits().count() == 20


def test_other_file_systems_are_refused(spark, tmp_path):
    assert local_path("file:/a%20b/c#d") == local_path("file:///a%20b/c#d") == "/a%20b/c#d"
    with pytest.raises(ValueError):
        backup_file_stream(VisitStore.create(spark, str(tmp_path / "s")), "hdfs://host/land", str(tmp_path / "ck"))


def test_a_torn_file_is_tried_again(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    torn = tmp_path / "land" / "u1" / "History"

    def run():
        backup_file_stream(store, str(tmp_path / "land"), str(tmp_path / "ck"), as_of=AS_OF).awaitTermination()
        return store.visits().count(), failed_files(store).count()

    torn.parent.mkdir(parents=True)
    torn.write_bytes(b"SQLite format 3\0 torn")
    assert run() == (0, 1)
    torn.unlink()
    history(torn, "chrome", entries(6))
    assert run() == (6, 0)
    torn.write_bytes(b"torn")
    assert run() == (6, 0)


def test_no_file_is_given_up(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    torn = tmp_path / "land" / "History"
    torn.parent.mkdir(parents=True)
    torn.write_bytes(b"torn")
    for _ in range(7):
        backup_files(store, paths=[str(torn)], as_of=AS_OF)
    assert failed_files(store).count() == 1
    assert [failed_files(store, before_run=7 + k).count() for k in (0, 50, 62, 63, 64)] == [0, 0, 0, 1, 1]
    torn.unlink()
    history(torn, "chrome", entries(6))
    assert tuples(backup_failed(store, as_of=AS_OF).summary) == [(6, 6, 0, 0)]


def test_the_source_streams_files_as_they_change(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    land = tmp_path / "land"
    whole = history(tmp_path / "elsewhere" / "History", "chrome", entries(60))
    content = open(whole, "rb").read()
    torn = land / "u1" / ".config" / "google-chrome" / "Default" / "History"
    torn.parent.mkdir(parents=True)

    def run():
        query = backup_history_stream(store, str(land), str(tmp_path / "ck"), as_of=AS_OF, settle_ms=0)
        query.awaitTermination()
        assert query.exception() is None
        return store.visits().count()

    for part in range(10):  # it is read, and torn, in each of ten batches
        torn.write_bytes(content[: 100 + part * (len(content) // 12)])
        assert run() == 0
    # Cut at some places a file looks like one without rows.
    assert store.import_runs().count() == 10 and store.import_runs().filter("error IS NOT NULL").count() > 5
    torn.write_bytes(content)
    os.utime(torn, (1, 1))  # a copy that keeps the time of its source
    assert run() == 60
    n_runs = store.import_runs().count()
    assert run() == 60 and store.import_runs().count() == n_runs  # nothing changed, nothing read
    late = fixtures.HistoryFile(str(land / "u2" / "places.sqlite"), "firefox", wal=True)
    for row in entries(9, 3):
        late.add(*row)
    late.close()
    assert run() == 69


def test_files_that_have_just_changed_wait(tmp_path):
    history(tmp_path / "a" / "History", "chrome", entries(2))
    reader = H.HistoryStreamReader({"landing": str(tmp_path), "settle_ms": "60000"})
    assert reader.latestOffset() == reader.initialOffset()
    reader = H.HistoryStreamReader({"landing": str(tmp_path), "settle_ms": "0"})
    end = reader.latestOffset()
    assert end["path"].endswith("a/History")
    assert len(reader.partitions(reader.initialOffset(), end)) == 1 and not reader.partitions(end, end)
    with pytest.raises(ValueError):
        H.HistoryStreamReader({})


def test_progress_rises_while_a_stream_runs(spark, tmp_path):
    store, landing = VisitStore.create(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    for seq in range(4):
        rows = rows_of(seq, f"/f{seq}", [(f"u{seq}-{i}", "t", NOON + i, 1) for i in range(5)])
        found(spark, rows).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(schema.FOUND_VISITS).option("maxFilesPerTrigger", 1).parquet(landing)
    progress = Progress("landed")
    query = backup_visit_stream(store, stream, str(tmp_path / "ck"), as_of=AS_OF, progress=progress)
    seen = []
    while query.isActive:
        time.sleep(0.02)
        row = progress.status(spark).first()
        seen.append((row.found, row.imported, row.ended))
    for _ in range(100):  # the last event comes after the end
        if progress.ended:
            break
        time.sleep(0.1)
    assert tuples(progress.status(spark)) == [("landed", 0, 20, 20, 0, True)]
    assert len({s for s in seen if 0 < s[0] < 20 and not s[2]}) >= 2 and seen == sorted(seen)
    steps = progress.steps(spark).collect()
    assert sum(s.found or 0 for s in steps) == sum(s.imported or 0 for s in steps) == 20
    assert any(s.rows_per_second for s in steps)


def test_progress_counts_files(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    for i in range(3):
        history(tmp_path / "land" / f"u{i}" / "History", "chrome", entries(4, i))
    (tmp_path / "land" / "u2" / "places.sqlite").write_bytes(b"torn")
    progress = Progress()
    options = {"as_of": AS_OF, "settle_ms": 0, "progress": progress}
    backup_history_stream(store, str(tmp_path / "land"), str(tmp_path / "ck"), **options).awaitTermination()
    for _ in range(100):
        if progress.ended:
            break
        time.sleep(0.1)
    assert progress.totals == {"files": 4, "found": 12, "imported": 12, "failed": 1}
