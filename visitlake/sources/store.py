"""The visit store: six Parquet tables below one folder.

``visits``       fact, partitioned by UTC day, sorted by time inside a day
``urls``         one row per url with its first title, in buckets by the url's hash
``import_runs``  append-only: what each run did with each file
``rollups``      append-only: figures per day of what each run has stored
``trigrams``     append-only: what keywords a file of visits may hold
``toplists``     the most frequent titles and domains of days

There is one writer at a time. Appends go urls, visits, rollups, runs. Urls and visits
are not appended twice, so a run that died half-way is repaired by running it again; days
whose rollups it may not have written are noted before and counted anew by the next run.

The smaller tables have generations, each in a folder of its own. An empty file in
``_tables`` names the current one, e.g. ``urls.3.64`` for the folder ``urls-3`` with 64
buckets. Compaction writes the next generation beside it and then that file, so a reader
sees one or the other; the generation before stays until the next compaction.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from visitlake import schema
from visitlake.functions import ranges, scalars
from visitlake.functions.ranges import TimeRange
from visitlake.operators import rollups, toplists, trigrams
from visitlake.sources.staging import (
    delete_folder,
    folder_bytes,
    folder_exists,
    folder_names,
    make_folder,
    read_text,
    write_text,
)

TABLES = {
    "visits": schema.VISITS,
    "urls": schema.URLS,
    "import_runs": schema.IMPORT_RUNS,
    "rollups": schema.ROLLUPS,
    "trigrams": schema.TRIGRAMS,
    "toplists": schema.TOPLISTS,
}
_EPOCH = date(1970, 1, 1)
POINTERS = "_tables"
LAGGING = "_lagging"
# Buckets of ``urls`` in a new store. Compaction doubles their number while one holds more
# bytes than this.
URL_BUCKETS, BUCKET_BYTES = 16, 128 << 20

# Names of files that a search leaves out, some hundred bytes each; it reads the others.
MOST_SKIPPED = 500_000

# The store is written once and read by every query.
COMPRESSION = "zstd"


@dataclass(frozen=True)
class Generation:
    """One version of a table; ``buckets`` is 0 for a table without."""

    table: str
    number: int
    buckets: int

    @property
    def folder(self) -> str:
        return f"{self.table}-{self.number}"

    @property
    def pointer(self) -> str:
        return f"{self.table}.{self.number}.{self.buckets}"

    @classmethod
    def named(cls, pointer: str) -> Generation:
        table, number, buckets = pointer.split(".")
        return cls(table, int(number), int(buckets))


class VisitStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, url_buckets: int = URL_BUCKETS) -> VisitStore:
        """Open a store, making its tables when they do not exist and finishing a
        compaction that was interrupted. ``url_buckets`` holds for a new store."""
        from visitlake.plans.compaction import recover  # it needs this module

        store = cls(spark, path)
        make_folder(spark, f"{store.path}/visits")
        make_folder(spark, f"{store.path}/{POINTERS}")
        there = {generation.table for generation in store.generations()}
        for name in TABLES:
            if name not in there and name != "visits":
                first = Generation(name, 0, url_buckets if name == "urls" else 0)
                make_folder(spark, f"{store.path}/{first.folder}")
                store.switch_to(first)
        recover(store)
        return store

    # --- generations ---

    def generations(self) -> list[Generation]:
        names = folder_names(self.spark, f"{self.path}/{POINTERS}")
        return [Generation.named(name) for name in names if not name.endswith(".part")]

    def generation(self, name: str) -> Generation:
        return max((g for g in self.generations() if g.table == name), key=lambda g: g.number)

    def switch_to(self, generation: Generation) -> None:
        if generation not in self.generations():
            write_text(self.spark, f"{self.path}/{POINTERS}/{generation.pointer}", "")

    def drop_older(self, name: str) -> None:
        """Removes the generations before the previous one."""
        now = self.generation(name).number
        for old in self.generations():
            if old.table == name and old.number < now - 1:
                delete_folder(self.spark, f"{self.path}/{POINTERS}/{old.pointer}")
                delete_folder(self.spark, f"{self.path}/{old.folder}")

    def _table(self, name: str) -> str:
        return f"{self.path}/{name if name == 'visits' else self.generation(name).folder}"

    def _bucketed(self, generation: Generation) -> str:
        """Name under which the session's catalog knows a generation of ``urls``.

        Buckets are known to the catalog only; the definition is made again in each
        session and holds nothing but the place and the layout.
        """
        place = f"{self.path}/{generation.folder}"
        name = f"spark_catalog.default.visitlake_urls_{hashlib.md5(place.encode()).hexdigest()}"
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.URLS)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression '{COMPRESSION}')"
            f" CLUSTERED BY (url_key) SORTED BY (url_key) INTO {generation.buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def read_table(self, name: str, path: str | None = None) -> DataFrame:
        """A table by name, or a copy of it elsewhere."""
        layout: StructType = TABLES[name]
        if name == "urls" and path is None:
            return self.spark.table(self._bucketed(self.generation(name)))
        return self.spark.read.schema(layout).parquet(path or self._table(name))

    # --- reading ---

    @property
    def zone(self):
        return ranges.session_zone(self.spark)

    def visits(self) -> DataFrame:
        return self.read_table("visits")

    def urls(self) -> DataFrame:
        return self.url_index().select("url", "title")

    def url_index(self) -> DataFrame:
        """url_key, url, title. A join by url_key does not shuffle this side, and literal
        keys read their buckets alone."""
        return self.read_table("urls")

    def import_runs(self) -> DataFrame:
        return self.read_table("import_runs")

    def import_log(self) -> DataFrame:
        """Every run's import records; ``latest_imports`` gives the current ones."""
        return self.import_runs().filter("last_import IS NOT NULL").select("data_path", "last_import", "run_seq")

    def visit_days(self) -> list[date]:
        """Days that have visits, from the names of the partitions; bounded by the
        calendar."""
        names = folder_names(self.spark, self._table("visits"))
        return sorted(date.fromisoformat(n.partition("=")[2]) for n in names if n.startswith("visit_day="))

    def edge_visits(self) -> DataFrame:
        """Visits of the first and the last day, which hold the first and last visit."""
        days = self.visit_days()
        return self.visits().filter(F.col("visit_day").isin(days[:1] + days[-1:]))

    def size_bytes(self) -> int:
        """Total bytes of the store's files, summed up by the file system."""
        return sum(folder_bytes(self.spark, self._table(name)) for name in TABLES)

    def size(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.size_bytes()).cast("bigint").alias("size_bytes"))

    def next_run_seq(self) -> int:
        last = self.import_runs().agg(F.max("run_seq").alias("last")).first()["last"]
        return 0 if last is None else last + 1

    # --- appending ---

    def append_urls(self, urls: DataFrame) -> None:
        """``urls`` has url_key, url and title. Each bucket gets one file."""
        self.write_urls(urls, self.generation("urls"))

    def write_urls(self, urls: DataFrame, generation: Generation) -> None:
        rows = urls.select(*schema.URLS.names).repartition(generation.buckets, "url_key")
        rows.write.insertInto(self._bucketed(generation))

    def append_visits(self, visits: DataFrame) -> None:
        """Append with few, evenly sized files per day.

        ``rebalance`` lets AQE split a day that holds far more rows than the
        others and merge small ones, so no writer task gets a whole hot day.
        """
        dated = visits.withColumn("visit_day", scalars.utc_day(F.col("visit_time")))
        self.write_visits(dated)

    def write_visits(self, visits: DataFrame, path: str | None = None, replace: bool = False) -> None:
        """Append to the table or to a copy elsewhere, or replace the days that occur."""
        writer = (
            visits.select(*schema.VISITS.names)
            .hint("rebalance", F.col("visit_day"))
            .sortWithinPartitions("visit_day", "visit_time")
            .write.mode("overwrite" if replace else "append")
            .partitionBy("visit_day")
        )
        if replace:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(path or self._table("visits"), compression=COMPRESSION)

    def write_small(self, rows: DataFrame, generation: Generation) -> None:
        """Append to a generation of a table without buckets."""
        place = f"{self.path}/{generation.folder}"
        rows.select(*TABLES[generation.table].names).write.mode("append").parquet(place, compression=COMPRESSION)

    def append_runs(self, report: DataFrame) -> None:
        self.write_small(report, self.generation("import_runs"))

    # --- keywords ---

    def _on(self, days: list[date] | TimeRange):
        day = F.col("visit_day")
        return day.between(*days.utc_days) if isinstance(days, TimeRange) else day.isin(days)

    def _below_visits(self, files: Iterable[str]) -> list[str]:
        """Paths below the folder of visits, as the index has them."""
        return [unquote(file[file.rindex("visit_day=") :]) for file in files]

    def index_keywords(self) -> None:
        """Adds the files that the keyword index does not have yet."""
        place = self._table("visits")
        known = {row["file"] for row in self.read_table("trigrams").select("file").distinct().collect()}
        fresh = [f for f in self._below_visits(self.visits().inputFiles()) if f not in known]
        if fresh:
            self._write_entries(fresh, place, self.generation("trigrams"))

    def _write_entries(self, files: list[str], place: str, generation: Generation) -> None:
        rows = self.spark.read.schema(schema.VISITS).option("basePath", place).parquet(*(f"{place}/{f}" for f in files))
        path = F.col("_metadata.file_path")
        file = F.url_decode(F.substring(path, F.instr(path, F.lit("visit_day=")), F.length(path)))
        found = rows.select("visit_day", file.alias("file"), "url", "title").mapInArrow(trigrams.entries, trigrams.ENTRIES)
        self.write_small(found, generation)

    def visits_matching(self, days: list[date] | TimeRange, keyword: str | None) -> DataFrame:
        """Visits of some days, without files that cannot hold the keyword."""
        rows = self.visits().filter(self._on(days))
        bits = trigrams.keyword_bits(keyword) if keyword else []
        if not bits:
            return rows
        index = self.read_table("trigrams").filter(self._on(days))
        skipped = trigrams.skippable(index, bits).limit(MOST_SKIPPED).collect()
        gone = {row["file"] for row in skipped}
        every = self._below_visits(rows.inputFiles())
        left = [file for file in every if file not in gone]
        if len(left) == len(every):
            return rows
        place = self._table("visits")
        if not left:
            return rows.filter(F.lit(False))
        read = self.spark.read.schema(schema.VISITS).option("basePath", place)
        return read.parquet(*(f"{place}/{file}" for file in left)).filter(self._on(days))

    # --- top lists ---

    def list_tops(self) -> None:
        """Makes the top lists of days that have none or have changed, as a new generation."""
        have = self.read_table("toplists")
        every = self.visit_days()
        if not every:
            return
        whole = TimeRange(scalars.DAY_MS * (every[0] - _EPOCH).days, scalars.DAY_MS * ((every[-1] - _EPOCH).days + 1))
        valid = [day.day for day in toplists.valid_days(have, self.rollups(), "title", whole)]
        stale = sorted(set(every) - set(valid))
        if not stale:
            return
        after = self.next_generation("toplists")
        self.write_small(have.filter(F.col("visit_day").isin(valid)).coalesce(1), after)
        self.write_small(toplists.day_lists(self.visits().filter(F.col("visit_day").isin(stale))), after)
        self.switch_to(after)
        self.drop_older("toplists")

    def next_generation(self, name: str) -> Generation:
        """An empty folder for the next version of a table."""
        now = self.generation(name)
        buckets = now.buckets
        while buckets and buckets * BUCKET_BYTES < folder_bytes(self.spark, f"{self.path}/{now.folder}"):
            buckets *= 2
        new = Generation(name, now.number + 1, buckets)
        # What a run that died has left there.
        delete_folder(self.spark, f"{self.path}/{new.folder}")
        make_folder(self.spark, f"{self.path}/{new.folder}")
        return new

    # --- rollups ---

    def rollups(self) -> DataFrame:
        return self.read_table("rollups")

    def append_rollups(self, visits: DataFrame, run_seq: int) -> None:
        """Figures of visits that a run has newly stored."""
        rows = rollups.figures(visits).withColumn("seq", F.lit(2 * run_seq).cast("bigint"))
        self.write_small(rows.withColumn("snapshot", F.lit(False)).coalesce(1), self.generation("rollups"))

    def snapshot_seq(self) -> int:
        """Between the last run and the next one."""
        return 2 * self.next_run_seq() - 1

    def note_days(self, days: list[date]) -> str:
        """Notes days whose rollups are about to lag behind; gives the note's name."""
        make_folder(self.spark, f"{self.path}/{LAGGING}")
        note = uuid.uuid4().hex
        write_text(self.spark, f"{self.path}/{LAGGING}/{note}", json.dumps([day.isoformat() for day in days]))
        return note

    def drop_note(self, note: str) -> None:
        delete_folder(self.spark, f"{self.path}/{LAGGING}/{note}")

    def repair_rollups(self) -> None:
        """Counts the noted days anew. Only a run that died leaves notes."""
        if not folder_exists(self.spark, f"{self.path}/{LAGGING}"):
            return
        notes = [name for name in folder_names(self.spark, f"{self.path}/{LAGGING}") if not name.endswith(".part")]
        if not notes:
            return
        read = (json.loads(read_text(self.spark, f"{self.path}/{LAGGING}/{note}")) for note in notes)
        days = sorted({date.fromisoformat(day) for note in read for day in note})
        rows = rollups.figures(self.visits().filter(F.col("visit_day").isin(days)))
        rows = rows.withColumns({"seq": F.lit(self.snapshot_seq()).cast("bigint"), "snapshot": F.lit(True)})
        self.write_small(rows.coalesce(1), self.generation("rollups"))
        for note in notes:
            self.drop_note(note)
