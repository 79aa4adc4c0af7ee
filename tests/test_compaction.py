"""Compaction keeps every row, also when it dies half-way."""

import pytest

from helpers import DAY_US, NOON, found, tuples
from test_ingest import rows_of
from visitlake.operators import rollups
from visitlake.plans import compaction
from visitlake.plans.backup import backup_visits
from visitlake.sources import staging
from visitlake.sources import store as store_module
from visitlake.sources.store import TABLES, URL_BUCKETS, VisitStore

AS_OF = "2024-01-30"


@pytest.fixture
def store(spark, tmp_path):
    store = VisitStore.create(spark, str(tmp_path / "store"))
    for run in range(4):
        rows = [(f"u{run}-{i}", "t", NOON + (i % 3) * DAY_US + run * 1000 + i, 0) for i in range(9)]
        backup_visits(store, found(spark, rows_of(run, f"/f{run}", rows)), as_of=AS_OF)
    return store


def content(store):
    tables = {name: store.read_table(name) for name in TABLES}
    # Sketches and run numbers of figures may differ, not the figures.
    tables["rollups"] = rollups.merged(tables["rollups"]).drop("urls", "domains")
    del tables["trigrams"], tables["toplists"]  # made by compaction
    return {name: sorted(tuples(rows), key=repr) for name, rows in tables.items()}


def files(store, name="visits"):
    return len(store.read_table(name).inputFiles())


def test_rows_stay_and_files_become_few(store):
    before = content(store)
    assert files(store) >= 12
    compaction.compact(store)
    assert content(store) == before
    assert files(store) == 3 and files(store, "urls") <= URL_BUCKETS and files(store, "import_runs") <= 2
    compaction.compact(store, store.visit_days()[:1])
    assert content(store) == before


def test_readers_keep_the_generation_they_have(spark, store):
    before = content(store)
    titles, runs = store.urls(), store.import_runs()
    n_titles, n_runs = titles.count(), runs.count()
    compaction.compact(store)
    assert (titles.count(), runs.count()) == (n_titles, n_runs)
    compaction.compact(store)
    assert sorted((g.table, g.number) for g in store.generations()) == [
        ("import_runs", 1), ("import_runs", 2), ("rollups", 1), ("rollups", 2),
        ("toplists", 0), ("toplists", 1), ("trigrams", 0), ("trigrams", 1), ("urls", 1), ("urls", 2),
    ]
    names = staging.folder_names(spark, store.path)
    assert {n for n in names if n.startswith(("urls", "import"))} == {"urls-1", "urls-2", "import_runs-1", "import_runs-2"}
    assert content(store) == before


def test_buckets_double_with_the_bytes(store, monkeypatch):
    before = content(store)
    monkeypatch.setattr(store_module, "BUCKET_BYTES", 100)
    compaction.compact(store)
    assert store.generation("urls").buckets > URL_BUCKETS
    assert content(store) == before


def test_a_compaction_that_dies_is_finished_or_dropped(spark, store, monkeypatch):
    before = content(store)
    for broken in ("write_text", "_put_in_place"):
        with monkeypatch.context() as patch:
            patch.setattr(compaction, broken, lambda *args: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                compaction.compact(store)
        again = VisitStore.create(spark, store.path)
        assert content(again) == before
    assert files(again) == 3  # the second had been complete

    put = compaction._put_in_place
    with monkeypatch.context() as patch:  # old files gone, new ones not yet there
        patch.setattr(compaction, "_put_in_place", lambda s, work: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compaction.compact(store)
    compaction.delete_folder(spark, f"{store.path}/visits/visit_day=2024-01-15")
    assert compaction._put_in_place is put
    assert content(VisitStore.create(spark, store.path)) == before
