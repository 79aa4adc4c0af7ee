"""Bench: headline queries on a store built from $BENCH_SF_DIR.

Prints one JSON line. ``backup`` loads a new store from the landed raw tables of
all three browsers, ``backup_again`` repeats that on the full store; ``files_*``
do the same from browser history files. The queries run on the store. Every
figure is the best of some rounds.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake import fixtures
from visitlake.functions import ranges
from visitlake.operators import aggregates, search
from visitlake.plans.backup import backup_files, backup_visits
from visitlake.plans.dashboard import dashboard
from visitlake.plans.history import History
from visitlake.session import build_session
from visitlake.sources import normalize
from visitlake.sources.export import export_csv
from visitlake.sources.store import VisitStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# The landed visits so many times over, to see a large store: BENCH_TIMES=120 gives
# 12 million visits at sf0.1.
TIMES = int(os.environ.get("BENCH_TIMES", "1"))
ROUNDS = 3
BACKUP_ROUNDS = 2
AS_OF = fixtures.AS_OF


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": f"{folder}/shared",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tz = ranges.session_zone(spark)
    month = ranges.resolve_range(None, None, AS_OF, tz)
    everything = ranges.full_range(AS_OF, tz)
    today = ranges.today_range(AS_OF, tz)

    browsers = ("chrome", "firefox", "safari")
    for browser in browsers:
        visits, pages = fixtures.raw_tables(spark, SF_DIR, browser)
        visits.write.parquet(f"{folder}/landed/{browser}/visits")
        pages.write.parquet(f"{folder}/landed/{browser}/pages")
    os.makedirs(f"{folder}/homes")
    fixtures.write_history_files(fixtures.found_visits(spark, SF_DIR).repartition(int(CPUS)), f"{folder}/homes").count()

    def landed() -> DataFrame:
        found = normalize.normalize_landed(
            tuple(spark.read.parquet(f"{folder}/landed/{b}/{name}") for name in ("visits", "pages"))
            for b in browsers
        )
        if TIMES == 1:
            return found
        # Each copy a second later, so that it is another visit of the same page.
        copies = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1))))
        return copies.withColumn("visit_time", F.col("visit_time") + F.col("copy") * 1_000_003).drop("copy")

    seconds: dict[str, float] = {}

    def record(name: str, action) -> None:
        seconds[name] = min(seconds.get(name, float("inf")), timed(action))

    for i in range(BACKUP_ROUNDS):
        store = VisitStore.create(spark, f"{folder}/store{i}")
        record("backup", lambda: backup_visits(store, landed(), as_of=AS_OF))
        record("backup_again", lambda: backup_visits(store, landed(), as_of=AS_OF))
        other = VisitStore.create(spark, f"{folder}/files{i}")
        record("files_backup", lambda: backup_files(other, homes=[f"{folder}/homes/*"], as_of=AS_OF))
        record("files_backup_again", lambda: backup_files(other, homes=[f"{folder}/homes/*"], as_of=AS_OF))

    def panels() -> None:
        with dashboard(store.visits(), month, AS_OF, tz, "net") as board:
            for panel in ("daily", "titles", "domains", "result_count", "span", "stats"):
                run(getattr(board, panel))

    api = History(store, as_of=AS_OF)
    record("index_keywords", store.index_keywords)
    record("list_tops", store.list_tops)
    queries = {
        "search": lambda: run(search.search_visits(store.visits(), month)),
        "search_keyword": lambda: run(search.search_visits(store.visits(), month, "EXAMPLE.n_t")),
        "search_limit": lambda: run(search.search_visits(store.visits(), month, limit=1000)),
        "day_details": lambda: run(search.day_details(store.visits(), "2024-01-10", tz)),
        "daily_counts": lambda: run(aggregates.daily_counts(store.visits(), month)),
        "title_top": lambda: run(aggregates.top_titles(store.visits(), month)),
        "domain_top": lambda: run(aggregates.top_domains(store.visits(), month)),
        "domain_top_compat": lambda: run(aggregates.top_domains(store.visits(), month, compat=True)),
        "kpi_stats": lambda: run(aggregates.kpi_stats(store.visits(), month, today)),
        "time_span": lambda: run(aggregates.time_span(store.edge_visits())),
        "status": lambda: run(aggregates.store_status(store.visits(), store.import_log(), store.edge_visits())),
        "dashboard": panels,
        "page": lambda: api.page(size=500),
        "search_indexed": lambda: run(api.search(keyword="EXAMPLE.n_t")),
        "daily_rolled": lambda: run(api.daily()),
        "kpi_rolled": lambda: run(api.key_figures()),
        "domain_top_listed": lambda: run(api.top("domain")),
        "export_csv": lambda: export_csv(store.visits(), everything, f"{folder}/csv"),
    }
    for _ in range(ROUNDS):
        for name, action in queries.items():
            record(name, action)
    spark.stop()
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
