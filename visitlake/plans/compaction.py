"""Fewer and larger files in a store that many runs have appended to.

The new files are first written beside the tables, then marked complete, and only
then put in place: days replace their partitions, the smaller tables become the next
generation. A run that dies before the mark changes nothing; one that dies after it is
finished by ``recover``, which opening the store calls. Like all writes it has the store
to itself; readers of the smaller tables see the old generation until it is replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import functions as F

from visitlake.operators import rollups
from visitlake.sources.staging import delete_folder, folder_exists, folder_names, read_text, write_text
from visitlake.sources.store import Generation, VisitStore

FOLDER = "_compaction"
READY = "READY"
DAY = "visit_day"


def compact(store: VisitStore, days: Sequence[date] | None = None) -> None:
    """Rewrite the visits of the given days, sorted by time, and the two small tables.

    Without ``days`` all days with visits are taken. A day that is larger than a
    write partition keeps several files.
    """
    recover(store)
    chosen = sorted(days) if days is not None else store.visit_days()
    work = f"{store.path}/{FOLDER}/{uuid.uuid4().hex}"
    rows = store.visits().filter(F.col(DAY).isin(list(chosen)))
    store.write_visits(rows, f"{work}/visits")
    after = [store.next_generation(name) for name in ("urls", "import_runs", "rollups")]
    # Read as plain files: Spark drops a repartition that buckets seem to make needless,
    # and then the buckets.
    store.write_urls(store.read_table("urls", f"{store.path}/{store.generation('urls').folder}"), after[0])
    store.write_small(store.import_runs().hint("rebalance"), after[1])
    days_figures = rollups.merged(store.rollups()).withColumns(
        {"seq": F.lit(store.snapshot_seq()).cast("bigint"), "snapshot": F.lit(True)}
    )
    store.write_small(days_figures.hint("rebalance"), after[2])
    ready = {"days": [d.isoformat() for d in chosen], "pointers": [g.pointer for g in after]}
    write_text(store.spark, f"{work}/{READY}", json.dumps(ready))
    _put_in_place(store, work)


def recover(store: VisitStore) -> None:
    """Finish compactions that were complete and drop the others."""
    root = f"{store.path}/{FOLDER}"
    if not folder_exists(store.spark, root):
        return
    for name in folder_names(store.spark, root):
        if folder_exists(store.spark, f"{root}/{name}/{READY}"):
            _put_in_place(store, f"{root}/{name}")
        else:
            delete_folder(store.spark, f"{root}/{name}")


def _put_in_place(store: VisitStore, work: str) -> None:
    """Replace the marked days and tables by their copies; may be repeated."""
    ready = json.loads(read_text(store.spark, f"{work}/{READY}"))
    if ready["days"]:
        # Only days that the copy has are replaced.
        store.write_visits(store.read_table("visits", f"{work}/visits"), replace=True)
    for pointer in ready["pointers"]:
        store.switch_to(Generation.named(pointer))
        store.drop_older(Generation.named(pointer).table)
    delete_folder(store.spark, work)
    _index_again(store)
    store.list_tops()


def _index_again(store: VisitStore) -> None:
    """The keyword index without files that are gone, and with the new ones."""
    here = store._below_visits(store.visits().inputFiles())
    old = store.read_table("trigrams")
    if old.select("file").distinct().count() > 0:
        new = store.next_generation("trigrams")
        names = store.spark.createDataFrame([(file,) for file in here], "file string")
        store.write_small(old.join(names, "file", "left_semi"), new)
        store.switch_to(new)
        store.drop_older("trigrams")
    store.index_keywords()
