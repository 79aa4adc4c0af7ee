"""What the optimizer makes of the queries."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import DAY_US, NOON, found, scanned
from visitlake import fixtures
from visitlake.functions import ranges as R
from visitlake.operators import aggregates as A
from visitlake.operators import bloom, ingest, search
from visitlake.plans.backup import backup_visits, stored_on
from visitlake.sources import normalize
from visitlake.sources.staging import Staging
from visitlake.sources.store import VisitStore

UTC = R.zone("UTC")
SPAN = R.resolve_range("2024-01-15", "2024-01-16", "2024-01-30", UTC)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = VisitStore.create(spark, str(tmp_path_factory.mktemp("store")))
    rows = [("http://h/", "t", NOON + i * DAY_US, 0, "chrome", "/p", 0, i) for i in range(10)]
    backup_visits(store, found(spark, rows), as_of="2024-01-30")
    return store


@pytest.fixture
def tiny_partitions(spark):
    """AQE thresholds scaled down to test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ranges_prune_partitions_and_reach_parquet(store):
    for frame in (
        search.search_visits(store.visits(), SPAN),
        A.daily_counts(store.visits(), SPAN, "x"),
        A.top_domains(store.visits(), SPAN),
        A.kpi_stats(store.visits(), SPAN, R.today_range("2024-01-20", UTC)),
    ):
        text = plan(frame)
        partition = text.split("PartitionFilters: [")[1].split("]")[0]
        pushed = text.split("PushedFilters: [")[1].split("]")[0]
        assert "visit_day" in partition
        assert "visit_time" in pushed
    narrowed = store.visits().filter("visit_day = date'2024-01-15'")
    assert narrowed.count() == 1


def test_only_needed_columns_are_read(store):
    def read(frame):
        return plan(frame).split("ReadSchema: struct<")[1].split(">")[0]

    assert read(A.daily_counts(store.visits(), SPAN)) == "visit_time:bigint"
    assert read(A.top_titles(store.visits(), SPAN)) == "title:string,visit_time:bigint"
    assert read(A.time_span(store.visits())) == "visit_time:bigint"
    assert read(A.browser_breakdown(store.visits())) == "browser:string"


def test_ends_of_a_store_are_read_from_two_days(store):
    edges = store.edge_visits()
    assert [d.isoformat() for d in (store.visit_days()[0], store.visit_days()[-1])] == ["2024-01-15", "2024-01-24"]
    assert edges.count() == 2 and A.time_span(edges).collect() == A.time_span(store.visits()).collect()
    text = plan(A.time_span(edges))
    assert "visit_day" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert scanned(store.visits()) == 10
    assert scanned(A.time_span(store.edge_visits())) == 2


def test_store_size_is_that_of_its_files(store):
    import pathlib

    on_disk = sum(p.stat().st_size for p in pathlib.Path(store.path).rglob("*.parquet"))
    assert store.size().first().size_bytes == store.size_bytes() == on_disk


def test_key_figures_multiply_no_rows(store):
    text = plan(A.kpi_stats(store.visits(), SPAN, R.today_range("2024-01-20", UTC), with_domains=True))
    assert "Expand" not in text


SMALL_CUT = re.compile(r"BroadcastHashJoin \[key_hash#\d+L\], \[key_hash#\d+L\], LeftSemi")
BLOOM_CUT = re.compile(r"BroadcastHashJoin \[pmod\(key_hash#\d+L, \d+\)\], \[segment#\d+L\], LeftSemi")


def stored_side(text):
    """The part of a plan below the second input of its last sort-merge or hash join."""
    lines = text.splitlines()
    join = next(i for i, line in enumerate(lines) if "LeftAnti" in line or "LeftOuter" in line)
    first = re.match(r"(.*?):- ", lines[join + 1])[1]
    second = next(i for i in range(join + 2, len(lines)) if lines[i].startswith(first + "+- "))
    return "\n".join(lines[second:])


def test_small_batches_cut_the_store_before_it_is_shuffled(spark, store, tiny_partitions):
    batch = ingest.dedup_visits(found(spark, [("http://h/", "t", NOON, 1, "b", "p", 0, 0)]))
    side = stored_side(plan(ingest.drop_stored_visits(batch, store.visits())))
    assert side.index("Exchange hashpartitioning(visit_time") < SMALL_CUT.search(side).start()
    assert ingest.drop_stored_visits(batch, store.visits()).count() == 0
    large = plan(ingest.drop_stored_visits(batch, store.visits(), ingest.MAX_BROADCAST_HASHES + 1))
    side = stored_side(large)
    assert not SMALL_CUT.search(large)
    assert side.index("Exchange hashpartitioning(visit_time") < BLOOM_CUT.search(side).start()


@pytest.fixture(scope="module")
def url_store(spark, tmp_path_factory):
    store = VisitStore.create(spark, str(tmp_path_factory.mktemp("urls")))
    rows = spark.range(0, 4_000, 1, 4).select(
        F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("t").alias("title"),
        F.lit(NOON).alias("visit_time"), F.col("id").alias("file_seq"), F.col("id").alias("src_row"),
    )
    store.append_urls(ingest.first_titles(rows))
    return store


def url_batch(spark, urls):
    return ingest.first_titles(found(spark, [(u, "new", NOON, 1, "b", "p", 0, i) for i, u in enumerate(urls)]))


def test_the_url_index_is_never_shuffled(spark, url_store, tiny_partitions):
    batch = Staging(spark, "test").write(url_batch(spark, ["http://h/7", "http://other/"]), "titles")
    for n_rows, cut in ((ingest.MAX_BROADCAST_HASHES + 1, False), (ingest.MAX_BROADCAST_HASHES, True)):
        resolved = ingest.resolve_titles(batch, url_store.url_index(), n_rows)
        text = plan(resolved)
        assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1
        side = stored_side(text)
        assert "Exchange hashpartitioning" not in side and ("BroadcastHashJoin" in side) is cut
        assert sorted((r.url, r.title, r.is_new) for r in resolved.collect()) == [
            ("http://h/7", "t", False), ("http://other/", "new", True),
        ]


def test_a_few_urls_read_their_buckets_alone(spark, url_store):
    rows = "numOutputRows"
    assert scanned(url_store.url_index(), rows) == 4_000
    batch = Staging(spark, "test").write(url_batch(spark, ["http://h/7", "http://other/"]), "titles")
    resolved = ingest.resolve_titles(batch, url_store.url_index(), 2)
    # Two of 16 buckets with about 250 rows each, and the two of the batch.
    assert 100 < scanned(resolved, rows) < 800
    assert resolved.filter("is_new").count() == 1


def test_bloom_filters_pass_all_keys_and_few_others(spark):
    n = 40_000
    keys = spark.range(n).select(F.xxhash64(F.col("id") * 2).alias("h"))
    others = spark.range(n).select(F.xxhash64(F.col("id") * 2 + 1).alias("h"))
    table = bloom.build(keys.unionByName(keys), "h", n)
    assert bloom.passing(keys, "h", table, n).count() == n
    assert bloom.passing(others, "h", table, n).count() < 0.02 * n
    rows = table.collect()
    assert len(rows) <= n // bloom.KEYS_A_SEGMENT + 2 and all(len(r.words) == bloom.SEGMENT_WORDS for r in rows)


@pytest.mark.parametrize("staged", [True, False])
def test_large_batches_get_a_filter_for_each_range_of_times(spark, monkeypatch, staged):
    monkeypatch.setattr(bloom, "MOST_KEYS", 1_000)
    hot = F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id"))  # a third of all rows at one instant
    rows = spark.range(6_000).select(hot.alias("visit_time"), F.concat(F.lit("u"), "id").alias("url"))
    batch, stored = rows.filter("url like '%7'"), rows.filter("url like '%7' or url like '%4'")
    n_batch = batch.count()
    assert len(bloom.time_slices(rows, "visit_time", 6_000)) > 2
    folders = [Staging(spark, "bloom") if staged else None for _ in range(3)]
    kept = bloom.cut(stored, batch, ["visit_time", "url"], "visit_time", 6_000, folders[0])
    assert kept.join(batch, ["visit_time", "url"]).count() == n_batch
    new = ingest.drop_stored_visits(rows, stored, 6_000, rows, folders[1])
    monkeypatch.setattr(ingest, "MAX_BROADCAST_HASHES", 10)
    assert ingest.drop_stored_visits(rows, stored, 6_000, rows, folders[2]).count() == new.count() == 6_000 - 2 * n_batch


def test_top_lists_need_no_full_sort(store):
    for frame in (
        A.top_titles(store.visits(), SPAN),
        A.top_domains(store.visits(), SPAN),
        search.search_visits(store.visits(), SPAN, limit=10),
    ):
        assert "TakeOrderedAndProject" in plan(frame)


def test_counts_are_combined_before_the_shuffle(store):
    text = plan(A.top_domains(store.visits(), SPAN))
    assert text.count("HashAggregate") == 2 and text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text


def test_dedup_combines_before_the_shuffle(spark):
    rows = found(spark, [("u", "t", 1, 1, "b", "p", 0, 0)])
    text = plan(ingest.dedup_visits(rows))
    assert "partial_min_by" in text and text.count("Exchange") == 1


def test_stored_side_of_the_dedup_is_limited_to_the_batch_days(store):
    days = [R.parse_day("2024-01-16"), R.parse_day("2024-01-18")]
    assert stored_on(store, days).count() == 2
    text = plan(stored_on(store, days).select("url"))
    assert "visit_day" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_hot_url_is_split_in_the_title_join(spark, tiny_partitions):
    n = 60_000
    rows = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.lit("t").alias("title"),
        F.xxhash64("id").alias("visit_time"),
        F.col("id").alias("file_seq"),
        F.col("id").alias("src_row"),
    )
    staging = Staging(spark, "test")
    titles = staging.write(ingest.first_titles(rows), "titles")  # as a backup does
    joined = ingest.apply_titles(staging.write(rows, "new"), titles)
    assert len(joined.collect()) == n
    assert "skew=true" in plan(joined)


def test_hot_day_is_split_among_writers(spark, tiny_partitions, tmp_path):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.concat(F.lit("u"), F.xxhash64("id")).alias("url"),
        F.lit("t").alias("title"),
        (F.lit(NOON) + F.when(F.col("id") % 3 == 0, F.col("id") * (DAY_US // 2000)).otherwise(F.col("id"))).alias("visit_time"),
        F.lit(0).cast("bigint").alias("visit_type"),
        F.lit("chrome").alias("browser"),
        F.lit("/p").alias("data_path"),
    )
    store = VisitStore.create(spark, str(tmp_path))
    store.append_visits(rows)
    assert store.visits().count() == 60_000
    hot = store.visits().filter("visit_day = date'2024-01-15'")
    per_file = hot.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 5 and max(r["count"] for r in per_file) < 40_000 / 4


def test_landed_range_stays_on_the_raw_column(spark):
    sf = "/root/testdata/sf0.001"
    for browser, column in (("chrome", "visit_time"), ("firefox", "visit_date"), ("safari", "visit_time")):
        visits, pages = fixtures.raw_tables(spark, sf, browser)
        spark_path = f"{spark.conf.get('spark.checkpoint.dir')}/raw-{browser}"
        visits.write.mode("overwrite").parquet(spark_path)
        landed = spark.read.parquet(spark_path)
        text = plan(normalize.normalize_landed([(landed, pages)], SPAN))
        assert f"GreaterThanOrEqual({column}," in text


def test_no_cross_join_and_no_python_in_the_queries(spark):
    import __spark_entry__ as entry

    jobs = re.compile(r"backup|streaming|history_\w+_scan|stored_status|compacted|detected|op\d+_|pipeline$")
    for name, query in entry.queries().items():
        if jobs.match(name):
            continue
        text = plan(query(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "Python" not in text and "InPandas" not in text, name
