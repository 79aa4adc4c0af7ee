"""Batch data source for browser history files (SQLite).

    spark.read.format("browser_history").option("homes", "/landing/*").load()
    spark.read.format("browser_history").load("/landing/u1/places.sqlite")

Options (lists are JSON arrays or a single string):

``homes``       directories (globs) laid out like home directories
``path/paths``  history files (globs), read after the detected ones
``start_ms``, ``end_ms``  inclusive time range, applied on the native column
``split_bytes`` target bytes per task; a larger file is read by several tasks

Filters on ``visit_time`` (microseconds since 1970) and ``browser`` reach SQLite: times
become bounds of the native column, and a file of another browser is not read further.

    spark.readStream.format("browser_history").option("landing", "/landing").load()

streams files as they land or change; see ``HistoryStreamReader``.

Files must lie on a file system mounted by every executor (``hadoop_files`` reads others). A file that cannot
be read yields an error row instead of failing the job. Rows that a browser has
not yet moved from its write-ahead log, or left half-way through a change, are
taken into account: such a file is read from a copy, as sorting this out writes.

The page a visit points to lies in the same file, so the two tables are joined
there, by primary key, and no Spark shuffle is needed to bring them together.
Codes stay native; ``normalize.normalize_history`` maps them.
"""

from __future__ import annotations

import glob
import json
import os
import re
import shutil
import sqlite3
import sys
import tempfile
import time
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from visitlake import schema
from visitlake.functions import ranges, scalars
from visitlake.sources import profiles

FORMAT = "browser_history"
DEFAULT_SPLIT_BYTES = 128 * 1024 * 1024
OPEN_COST_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 16_384
STAT_THREADS = 32
# Endings of the files in which SQLite keeps changes beside a database.
SIDECARS = ("-wal", "-journal")

ARROW_SCHEMA = pa.schema(
    [
        ("data_path", pa.string()),
        ("file_seq", pa.int64()),
        ("browser", pa.string()),
        ("src_row", pa.int64()),
        ("url", pa.string()),
        ("title", pa.string()),
        ("native_time", pa.int64()),
        ("native_seconds", pa.float64()),
        ("native_type", pa.int64()),
        ("visit_time", pa.int64()),
        ("error", pa.string()),
    ]
)


@dataclass(frozen=True)
class Layout:
    """Names of one browser family's tables and columns."""

    browser: str
    visits: str
    pages: str
    page_key: str
    title: str
    time: str
    kind: str | None


# Table layouts, in the order in which they are probed.
LAYOUTS = (
    Layout("firefox", "moz_historyvisits", "moz_places", "place_id", "p.title", "visit_date", "visit_type"),
    Layout("safari", "history_visits", "history_items", "history_item", "title", "visit_time", None),
    Layout("chrome", "visits", "urls", "url", "p.title", "visit_time", "transition"),
)
PROBE_TABLES = {"firefox": "moz_historyvisits", "safari": "history_items", "chrome": "visits"}


@dataclass(frozen=True)
class Wanted:
    """Which visits a reader is asked for: inclusive milliseconds, and what filters have
    added: inclusive microseconds and browsers (None: all)."""

    start_ms: int = 0
    end_ms: int = 2**53
    low_us: int | None = None
    high_us: int | None = None
    browsers: frozenset[str] | None = None

    def after(self, us: int) -> Wanted:
        return replace(self, low_us=us if self.low_us is None else max(us, self.low_us))

    def before(self, us: int) -> Wanted:
        return replace(self, high_us=us if self.high_us is None else min(us, self.high_us))

    def of(self, browsers: Iterable[str]) -> Wanted:
        found = frozenset(browsers)
        return replace(self, browsers=found if self.browsers is None else self.browsers & found)

    def native_bounds(self, browser: str) -> tuple:
        """Bounds of the native column. They may be wider than a filter by a rounding
        error, as Spark applies it again."""
        low, high = ranges.TimeRange(self.start_ms, self.end_ms).native_bounds(browser)
        if browser == "safari":
            shift, slack = -scalars.NSDATE_TO_UNIX_SECONDS, 1e-5
            more = [None if us is None else us / 1_000_000.0 + shift for us in (self.low_us, self.high_us)]
        else:
            shift, slack = scalars.WEBKIT_TO_UNIX_SECONDS * 1_000_000 if browser == "chrome" else 0, 0
            more = [None if us is None else us + shift for us in (self.low_us, self.high_us)]
        low = low if more[0] is None else max(low, more[0] - slack)
        return low, high if more[1] is None else min(high, more[1] + slack)


def pushed(wanted: Wanted, filters: Iterable[Filter]) -> Wanted:
    """What is left to read under filters, which all have to hold."""
    for test in filters:
        column, value = getattr(test, "attribute", None), getattr(test, "value", None)
        if column == ("visit_time",) and isinstance(value, int):
            if isinstance(test, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                wanted = wanted.after(value + isinstance(test, GreaterThan))
            if isinstance(test, (EqualTo, LessThan, LessThanOrEqual)):
                wanted = wanted.before(value - isinstance(test, LessThan))
        elif column == ("browser",):
            if isinstance(test, EqualTo):
                wanted = wanted.of([value])
            elif isinstance(test, In):
                wanted = wanted.of(test.value)
    return wanted


@dataclass(frozen=True)
class FileSlice:
    """Part ``k`` of ``n`` of one file, cut by row id."""

    path: str
    file_seq: int
    k: int
    n: int


class SliceGroup(InputPartition):
    def __init__(self, slices: list[FileSlice]):
        self.slices = slices


def local_path(path: str) -> str:
    """The path as the tasks open it. Spark's paths are not URL-encoded, so only a
    ``file:`` scheme goes; paths of other file systems are refused, not rewritten."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(/.*)", path)
    if scheme is None:
        return path
    if scheme[1] != "file":
        raise ValueError(f"history files are opened through a mounted path, not {path}")
    return "/" + scheme[2].lstrip("/")


def detect_layout(tables: set[str]) -> Layout:
    for layout in LAYOUTS:
        if PROBE_TABLES[layout.browser] in tables:
            return layout
    raise ValueError("no known browser history tables in this file")


def plan_slices(files: list[tuple[str, int]], split_bytes: int) -> list[list[FileSlice]]:
    """Cut big files and pack small ones so that tasks get similar work."""
    groups: list[list[FileSlice]] = []
    current: list[FileSlice] = []
    load = 0
    for seq, (path, size) in enumerate(files):
        n = max(1, -(-size // split_bytes))
        cost = size // n + OPEN_COST_BYTES
        for k in range(n):
            if current and load + cost > split_bytes:
                groups.append(current)
                current, load = [], 0
            current.append(FileSlice(path, seq, k, n))
            load += cost
    if current:
        groups.append(current)
    return groups


def _bytes(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:
        return 0


def list_files(homes: list[str], paths: list[str]) -> list[tuple[str, int]]:
    """Detected files first, then the named ones, each with its size.

    A named path that does not exist is kept: reading it reports the failure.
    """
    found: list[str] = []
    for home in homes:
        for pattern in profiles.patterns_below(home):
            found.extend(sorted(glob.glob(pattern, include_hidden=True)))
    for path in paths:
        if glob.has_magic(path) and not os.path.exists(path):
            found.extend(sorted(glob.glob(path, include_hidden=True)))
        else:
            found.append(path)

    def size(path: str) -> int:
        return sum(_bytes(path + ending) for ending in ("", *SIDECARS))

    with ThreadPoolExecutor(STAT_THREADS) as pool:
        return list(zip(found, pool.map(size, found)))


def _decoded(values: tuple) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _titles(values: tuple) -> pa.Array:
    """Titles as text; a title that is no valid UTF-8 becomes NULL."""
    try:
        return _decoded(values)
    except pa.ArrowInvalid:

        def text(raw):
            try:
                return None if raw is None else raw.decode("utf-8")
            except UnicodeDecodeError:
                return None

        return pa.array([text(v) for v in values], pa.string())


def _slice_query(layout: Layout) -> str:
    kind = f"v.{layout.kind}" if layout.kind else "-1"
    return (
        f"SELECT v.rowid,"
        f" CASE typeof(p.url) WHEN 'text' THEN p.url END,"
        f" CASE typeof({layout.title}) WHEN 'text' THEN {layout.title} END,"
        f" v.{layout.time}, {kind}"
        f" FROM {layout.visits} AS v JOIN {layout.pages} AS p ON p.id = v.{layout.page_key}"
        f" WHERE v.rowid BETWEEN ? AND ? AND v.{layout.time} BETWEEN ? AND ?"
    )


def _row_span(db: sqlite3.Connection, layout: Layout, k: int, n: int) -> tuple[int, int]:
    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {layout.visits}").fetchone()
    if low is None:
        return 0, -1
    width = high - low + 1
    return low + width * k // n, low + width * (k + 1) // n - 1


class Opener:
    """Opens the files of one task; copies those with changes beside them, once."""

    def __init__(self):
        self.copies: dict[str, str] = {}

    def __enter__(self) -> Opener:
        return self

    def __exit__(self, *exc) -> None:
        for copy in self.copies.values():
            shutil.rmtree(os.path.dirname(copy), ignore_errors=True)

    def open(self, path: str) -> sqlite3.Connection:
        if not any(_bytes(path + ending) for ending in SIDECARS):
            return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro&immutable=1", uri=True)
        if path not in self.copies:
            # Scratch of this task alone, gone when it ends.
            copy = os.path.join(tempfile.mkdtemp(prefix="history-"), "copy")
            self.copies[path] = copy
            for ending in ("", *SIDECARS):
                if ending == "" or _bytes(path + ending):
                    shutil.copyfile(path + ending, copy + ending)
        return sqlite3.connect(f"file:{quote(self.copies[path])}?mode=rw", uri=True)


def _unified(browser: str, when: tuple) -> pa.Array:
    """Native times as microseconds since 1970, truncated like ``scalars.nsdate_to_us``."""
    if browser != "safari":
        shift = scalars.WEBKIT_TO_UNIX_SECONDS * 1_000_000 if browser == "chrome" else 0
        return pa.array(np.array(when, np.int64) - shift)
    seconds = np.array(when, np.float64)
    return pa.array(((seconds + float(scalars.NSDATE_TO_UNIX_SECONDS)) * 1_000_000.0).astype(np.int64))


def read_slice(part: FileSlice, wanted: Wanted, opener: Opener | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one slice as Arrow batches. Raises when the file is unusable."""
    if opener is None:
        with Opener() as own:
            yield from read_slice(part, wanted, own)
        return
    yield from read_open(opener.open(part.path), part, wanted)


def read_open(db: sqlite3.Connection, part: FileSlice, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """The same from an open database, which is closed at the end."""
    try:
        db.text_factory = bytes
        names = db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")
        layout = detect_layout({name.decode("utf-8", "replace") for (name,) in names})
        if wanted.browsers is not None and layout.browser not in wanted.browsers:
            return
        low, high = _row_span(db, layout, part.k, part.n)
        cursor = db.execute(_slice_query(layout), (low, high, *wanted.native_bounds(layout.browser)))
        while rows := cursor.fetchmany(BATCH_ROWS):
            src_row, url, title, when, kind = zip(*rows)
            count = len(rows)
            urls = _decoded(url)
            if urls.null_count:
                raise ValueError("a visit without a readable url")
            if None in kind:
                raise ValueError("a visit without a type")
            blank = pa.nulls(count)
            seconds = layout.browser == "safari"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(part.path, count),
                    pa.repeat(pa.scalar(part.file_seq, pa.int64()), count),
                    pa.repeat(layout.browser, count),
                    pa.array(src_row, pa.int64()),
                    urls,
                    _titles(title),
                    blank.cast(pa.int64()) if seconds else pa.array(when, pa.int64()),
                    pa.array(when, pa.float64()) if seconds else blank.cast(pa.float64()),
                    pa.array(kind, pa.int64()),
                    _unified(layout.browser, when),
                    blank.cast(pa.string()),
                ],
                schema=ARROW_SCHEMA,
            )
    finally:
        db.close()


UNREADABLE = (sqlite3.Error, pa.ArrowException, ValueError, OverflowError, OSError, TypeError)


def rows_and_status(part: FileSlice, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a slice; a row of the file itself follows with its first slice, and
    with each that fails."""
    error = None
    try:
        yield from rows
    except UNREADABLE as exc:
        error = f"{type(exc).__name__}: {exc}"
    if error is not None or part.k == 0:
        yield status_row(part, error)


def read_slices(parts: Iterable[FileSlice], wanted: Wanted) -> Iterator[pa.RecordBatch]:
    with Opener() as opener:
        for part in parts:
            yield from rows_and_status(part, read_slice(part, wanted, opener))


def status_row(part: FileSlice, error: str | None) -> pa.RecordBatch:
    row = {name: None for name in ARROW_SCHEMA.names}
    row.update(data_path=part.path, file_seq=part.file_seq, error=error)
    return pa.RecordBatch.from_pylist([row], schema=ARROW_SCHEMA)


def _as_list(options: dict[str, str], name: str) -> list[str]:
    text = options.get(name, "").strip()
    if not text:
        return []
    return json.loads(text) if text.startswith("[") else [text]


def _wanted(options: dict[str, str]) -> Wanted:
    return Wanted(int(options.get("start_ms", 0)), int(options.get("end_ms", 2**53)))


class HistoryFileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.homes = _as_list(options, "homes")
        self.paths = _as_list(options, "path") + _as_list(options, "paths")
        self.wanted = _wanted(options)
        self.split_bytes = int(options.get("split_bytes", DEFAULT_SPLIT_BYTES))
        if not self.homes and not self.paths:
            raise ValueError("browser_history needs a path or the option 'homes'")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can; Spark applies all of them again."""
        self.wanted = pushed(self.wanted, filters)
        return filters

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.homes, self.paths)
        groups = plan_slices(files, self.split_bytes)
        return [SliceGroup(group) for group in groups] or [SliceGroup([])]

    def read(self, partition: SliceGroup) -> Iterator[pa.RecordBatch]:
        return read_slices(partition.slices, self.wanted)


# Names of the files in which browsers keep their history.
HISTORY_NAMES = ("History", "places.sqlite", "History.db")
SETTLE_MS = 1_000


def landed(folder: str, names: Sequence[str] = HISTORY_NAMES) -> list[tuple[int, str, int]]:
    """(stamp, path, size) of history files anywhere below a folder, hidden ones too.

    The stamp is the latest change of a file or of what lies beside it, in nanoseconds.
    It is the time that the file system sets, which a copy cannot carry over.
    """
    found = []
    for place, _, files in os.walk(folder):
        for name in set(files).intersection(names):
            path = os.path.join(place, name)
            stamp = size = 0
            for ending in ("", *SIDECARS):
                try:
                    seen = os.stat(path + ending)
                except OSError:
                    continue
                stamp, size = max(stamp, seen.st_ctime_ns), size + seen.st_size
            if stamp:
                found.append((stamp, path, size))
    return sorted(found)


class HistoryStreamReader(DataSourceStreamReader):
    """Files below the folder ``landing``, each as often as it changes.

    An offset is the stamp and path of the last file taken, so no names are kept and a
    file that was read while it was still being copied comes again when more of it is
    there, however often. Files changed in the last ``settle_ms`` are left for the next
    batch: one that changes at the instant of an offset is not missed. A batch that is
    replayed reads the files that have not changed since; the others follow.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options.get("landing") or options.get("path")
        if not self.folder:
            raise ValueError("a stream of browser_history needs the option 'landing'")
        self.names = _as_list(options, "file_names") or list(HISTORY_NAMES)
        self.settle_ms = int(options.get("settle_ms", SETTLE_MS))
        self.split_bytes = int(options.get("split_bytes", DEFAULT_SPLIT_BYTES))
        self.wanted = _wanted(options)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"stamp": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - self.settle_ms * 1_000_000
        settled = [(stamp, path) for stamp, path, _ in landed(self.folder, self.names) if stamp <= until]
        if settled and settled[-1] > (self.last["stamp"], self.last["path"]):
            self.last = dict(zip(("stamp", "path"), settled[-1]))
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((offset["stamp"], offset["path"]) for offset in (start, end))
        self.last = max(self.last, end, key=lambda offset: (offset["stamp"], offset["path"]))
        files = [(path, size) for stamp, path, size in landed(self.folder, self.names) if low < (stamp, path) <= high]
        return [SliceGroup(group) for group in plan_slices(sorted(files), self.split_bytes)]

    def read(self, partition: SliceGroup) -> Iterator[pa.RecordBatch]:
        return read_slices(partition.slices, self.wanted)

    def commit(self, end: dict) -> None:
        pass


class HistoryFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return schema.SOURCE_ROWS

    def reader(self, schema: StructType) -> HistoryFileReader:
        return HistoryFileReader(self.options)

    def streamReader(self, schema: StructType) -> HistoryStreamReader:
        return HistoryStreamReader(self.options)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it.

    The classes travel to the executors by value, so the package need not be
    installed there.
    """
    for module in (schema, scalars, ranges, profiles):
        cloudpickle.register_pickle_by_value(module)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(HistoryFileSource)
    spark.conf.set(PUSHDOWN, "true")
