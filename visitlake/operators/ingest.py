"""Set-based ingest steps: dedup, first titles, import log, reports.

"First" always means the order (file_seq, visit_time, src_row), never the order
in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.predicates import in_range
from visitlake.functions.ranges import TimeRange
from visitlake.operators import bloom
from visitlake.sources.staging import Staging

# The time goes first: it decides nearly every comparison of a sort by this key,
# while urls share their first bytes, all that a sort prefix can hold.
VISIT_KEY = ["visit_time", "url"]
# For the same reason urls are sorted and joined by their hash first. The url
# stays in the key, so colliding hashes do no harm.
URL_KEY = ["url_key", "url"]
# Hashes of so many keys take some 100 MB as a broadcast relation.
MAX_BROADCAST_HASHES = 2_000_000
# So few keys go into the plan as literals, which prune buckets and row groups.
MAX_LISTED_KEYS = 1_000
NO_URL = "ValueError: a visit without a readable url"


def _url_key():
    return F.xxhash64("url").alias("url_key")


def accepted_visits(found: DataFrame, accepted: TimeRange) -> DataFrame:
    """Rows a backup takes: nothing before 1970 or after tomorrow midnight."""
    return found.filter(in_range(found, accepted))


def landed_files(found: DataFrame, accepted: TimeRange) -> DataFrame:
    """data_path and error of the files that landed rows come from."""
    bad = F.col("url").isNull() & in_range(found, accepted)
    return found.groupBy("data_path").agg(F.max(F.when(bad, F.lit(NO_URL))).alias("error"))


def dedup_visits(found: DataFrame) -> DataFrame:
    """First row per (url, visit_time).

    The partial aggregate runs before the shuffle, so many copies of one file
    cost one row per task and key.
    """
    rest = [c for c in found.columns if c not in VISIT_KEY]
    first = F.min_by(F.struct(*rest), F.struct("file_seq", "src_row"))
    return found.groupBy(*VISIT_KEY).agg(first.alias("row")).select(*VISIT_KEY, "row.*")


def _few(frame: DataFrame, n_rows: int | None) -> bool:
    """Whether 8-byte hashes of the rows may be broadcast. ``n_rows`` is an upper
    bound that is known already; else the rows are counted up to the limit."""
    if n_rows is None:
        n_rows = frame.limit(MAX_BROADCAST_HASHES + 1).count()
    return n_rows <= MAX_BROADCAST_HASHES


def drop_stored_visits(
    candidates: DataFrame,
    stored: DataFrame,
    n_rows: int | None = None,
    batch: DataFrame | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    """Candidates whose (url, visit_time) is not in the store yet.

    The anti-join can only ever build its stored side, which is shuffled; the
    candidates come out of ``dedup_visits`` partitioned by the same key. So the
    store is cut first and hardly any of it is shuffled: by the broadcast hashes of
    the candidates when there are few enough, else by Bloom filters of ``batch``,
    any cheaper frame with the candidates' keys (repeats do no harm). The exact join
    stays last, and colliding hashes do no harm.
    """
    known = stored.select(*VISIT_KEY)
    if _few(candidates, n_rows):
        hashes = candidates.select(F.xxhash64(*VISIT_KEY).alias("key_hash"))
        known = known.withColumn("key_hash", F.xxhash64(*VISIT_KEY))
        known = known.join(F.broadcast(hashes), "key_hash", "left_semi").drop("key_hash")
    else:
        keys = candidates if batch is None else batch
        n_keys = candidates.count() if n_rows is None else n_rows
        known = bloom.cut(known, keys.select(*VISIT_KEY), VISIT_KEY, "visit_time", n_keys, staging)
    return candidates.join(known, VISIT_KEY, "left_anti")


def first_titles(visits: DataFrame) -> DataFrame:
    """url_key, url and the first title of each url, even when that is blank.

    On output of ``dedup_visits`` the result is the same as on all rows: the
    first row of a url is also the first of its (url, visit_time).
    """
    order = F.struct("file_seq", "visit_time", "src_row")
    return visits.groupBy(_url_key(), "url").agg(F.min_by("title", order).alias("title"))


def resolve_titles(titles: DataFrame, stored_urls: DataFrame, n_rows: int | None = None) -> DataFrame:
    """url_key, url, title, is_new: a stored title wins, blank or not.

    ``stored_urls`` has url_key, url and title. The store keeps them in buckets by
    url_key, so only the batch is shuffled, to the buckets. Very few keys name their
    buckets, and no other is read; few ones cut the stored side as in
    ``drop_stored_visits`` before it is sorted.
    """
    known = stored_urls.select(
        F.col("url_key").alias("known_key"), F.col("url").alias("known_url"),
        F.col("title").alias("stored_title"), F.lit(True).alias("is_known"),
    )
    if n_rows is not None and n_rows <= MAX_LISTED_KEYS:
        keys = [row["url_key"] for row in titles.select("url_key").distinct().collect()]
        known = known.filter(F.col("known_key").isin(keys))
    elif _few(titles, n_rows):
        keys = titles.select(F.col("url_key").alias("known_key"))
        known = known.join(F.broadcast(keys), "known_key", "left_semi")
    # Two bounds, not an equality, as the buckets go by the first key alone.
    same_url = (F.col("known_url") <= F.col("url")) & (F.col("known_url") >= F.col("url"))
    return titles.join(known, (F.col("url_key") == F.col("known_key")) & same_url, "left").select(
        *URL_KEY,
        F.when(F.col("is_known"), F.col("stored_title")).otherwise(F.col("title")).alias("title"),
        F.col("is_known").isNull().alias("is_new"),
    )


def apply_titles(visits: DataFrame, titles: DataFrame) -> DataFrame:
    """Each visit gets its url's title.

    A url with a large part of all visits is split by AQE's skew join: titles
    has one row per url, and nothing after the join needs its partitioning.
    """
    untitled = visits.drop("title").withColumn("url_key", _url_key())
    return untitled.join(titles.select(*URL_KEY, "title"), URL_KEY, "inner").drop("url_key")


def profile_found(found: DataFrame) -> DataFrame:
    """Rows and last visit time per file and UTC day.

    All that a run needs to know about its input besides the rows: the days it
    touches, the import log entries and the counts of the report. One scan of
    two columns.
    """
    return found.groupBy("data_path", scalars.utc_day(F.col("visit_time")).alias("day")).agg(
        F.count(F.lit(1)).alias("n_found"), F.max("visit_time").alias("last_time")
    )


def import_records(profile: DataFrame, run_seq: int) -> DataFrame:
    """Log entries of a run: the last visit time of every file with rows."""
    return (
        profile.groupBy("data_path")
        .agg(F.max("last_time").alias("last_import"))
        .withColumn("run_seq", F.lit(run_seq).cast("bigint"))
    )


def latest_imports(log: DataFrame) -> DataFrame:
    """Current state of the import log: the latest run's entry per file."""
    return log.groupBy("data_path").agg(F.max_by("last_import", "run_seq").alias("last_import"))


def file_report(files: DataFrame, profile: DataFrame, imported: DataFrame) -> DataFrame:
    """Per file: found, imported, duplicated, last_import, error.

    ``files`` has one row per source file with its error, if any; ``profile`` is
    that of the accepted rows of good files and ``imported`` the newly stored
    rows, which are credited to the first file that had them.
    """
    n_new = imported.groupBy("data_path").agg(F.count(F.lit(1)).alias("n_new"))
    n_found = F.coalesce("n_found", F.lit(0))
    imported_here = F.coalesce("n_new", F.lit(0))
    return (
        files.join(_per_file(profile), "data_path", "left")
        .join(n_new, "data_path", "left")
        .select(
            "data_path",
            n_found.alias("found"),
            imported_here.alias("imported"),
            (n_found - imported_here).alias("duplicated"),
            "last_import",
            "error",
        )
    )


def _per_file(profile: DataFrame) -> DataFrame:
    return profile.groupBy("data_path").agg(
        F.sum("n_found").alias("n_found"), F.max("last_time").alias("last_import")
    )


def dry_run_report(rows: DataFrame, accepted: TimeRange) -> DataFrame:
    """Report of a run that writes nothing: only ``found`` is counted.

    ``rows`` are a run's input with the columns data_path, url, visit_time and
    error; a row with an error fails its file. One pass with a map-side combine.
    """
    zero = F.lit(0).cast("bigint")
    counts = in_range(rows, accepted) & F.col("url").isNotNull()
    files = rows.groupBy("data_path").agg(
        F.count_if(counts).alias("n"),
        F.max(F.when(counts, F.col("visit_time"))).alias("last"),
        F.min("error").alias("error"),
    )
    fine = F.col("error").isNull()
    return files.select(
        "data_path",
        F.when(fine, F.col("n")).otherwise(zero).alias("found"),
        zero.alias("imported"),
        zero.alias("duplicated"),
        F.when(fine, F.col("last")).alias("last_import"),
        "error",
    )


def run_summary(report: DataFrame) -> DataFrame:
    """One row: found, imported, duplicated, failed files."""

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    failed = F.count_if(F.col("error").isNotNull()).alias("failed")
    return report.agg(total("found"), total("imported"), total("duplicated"), failed)
