"""Compare every registered query with its SQL oracle on one data folder.

Run as a script for a report, or through test_oracle.py.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark, db, name: str, sf_dir: str) -> str | None:
    """None when both engines agree, else what differs."""
    frame = entry.queries()[name](spark, sf_dir)
    spark_cols, spark_rows = _sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql()[name]
    cursor = db.execute(sql)
    sql_cols, sql_rows = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_cols != sql_cols:
        return f"columns {spark_cols} != {sql_cols}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)} rows"
    for mine, theirs in zip(spark_rows, sql_rows):
        if mine != theirs or [type(x) for x in mine] != [type(x) for x in theirs]:
            return f"{spark_cols}: {mine} != {theirs}"
    return None


if __name__ == "__main__":
    from visitlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    database = connect(sf)
    for query in only or entry.oracle_sql():
        started = time.time()
        try:
            problem = differences(spark, database, query, sf)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {query:26s} {time.time() - started:6.2f} {problem or ''}")
    print("no oracle:", sorted(set(entry.queries()) - set(entry.oracle_sql())))
