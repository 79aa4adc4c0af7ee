"""Schemas of every frame that crosses a module boundary.

Times are BIGINT microseconds since 1970-01-01 UTC at rest (``visit_time``) and
BIGINT milliseconds in results (columns ending in ``_ms``).
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# What a reader of browser files yields. A row with a NULL url is a status row
# of the file itself; its ``error`` is NULL when the file opened fine.
SOURCE_ROWS = _struct(
    ("data_path", T.StringType()),
    ("file_seq", T.LongType()),
    ("browser", T.StringType()),
    ("src_row", T.LongType()),
    ("url", T.StringType()),
    ("title", T.StringType()),
    ("native_time", T.LongType()),
    ("native_seconds", T.DoubleType()),
    ("native_type", T.LongType()),
    ("visit_time", T.LongType()),
    ("error", T.StringType()),
)

# Normalised visits before dedup; (file_seq, visit_time, src_row) is the total
# order in which "first wins" is decided.
FOUND_VISITS = _struct(
    ("url", T.StringType()),
    ("title", T.StringType()),
    ("visit_time", T.LongType()),
    ("visit_type", T.LongType()),
    ("browser", T.StringType()),
    ("data_path", T.StringType()),
    ("file_seq", T.LongType()),
    ("src_row", T.LongType()),
)

# ``url_key`` is the url's hash, by which the table is bucketed and sorted.
URLS = _struct(("url_key", T.LongType()), ("url", T.StringType()), ("title", T.StringType()))

VISITS = _struct(
    ("url", T.StringType()),
    ("title", T.StringType()),
    ("visit_time", T.LongType()),
    ("visit_type", T.LongType()),
    ("browser", T.StringType()),
    ("data_path", T.StringType()),
    ("visit_day", T.DateType()),
)

# One row per source file and run. The import log is the part of it that has a
# ``last_import``: files without accepted rows leave no record.
IMPORT_RUNS = _struct(
    ("run_seq", T.LongType()),
    ("data_path", T.StringType()),
    ("found", T.LongType()),
    ("imported", T.LongType()),
    ("duplicated", T.LongType()),
    ("last_import", T.LongType()),
    ("error", T.StringType()),
)

# What ``operators.rollups`` keeps of each day; the sketches are in its row with quarter -1.
ROLLUPS = _struct(
    ("visit_day", T.DateType()),
    ("quarter", T.IntegerType()),
    ("n_visits", T.LongType()),
    ("urls", T.BinaryType()),
    ("domains", T.BinaryType()),
    ("seq", T.LongType()),
    ("snapshot", T.BooleanType()),
)

# Bitmaps of ``operators.trigrams``; ``file`` is the path below the store's visits.
TRIGRAMS = _struct(
    ("visit_day", T.DateType()),
    ("file", T.StringType()),
    ("bits", T.ArrayType(T.LongType())),
)

# The most frequent titles and domains of a day, as ``operators.toplists`` makes them.
TOPLISTS = _struct(
    ("visit_day", T.DateType()),
    ("kind", T.StringType()),
    ("name", T.StringType()),
    ("n", T.LongType()),
    ("rest", T.LongType()),
    ("n_visits", T.LongType()),
)
