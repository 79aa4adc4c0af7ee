"""Keyword semantics, compared with SQLite's own LIKE."""

import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import NOON, tuples, visits
from visitlake.functions import predicates as P
from visitlake.operators import search
from visitlake.functions.ranges import TimeRange

ALPHABET = "aAbBzZnetäÄKßé€%_\\.*+?()[]{}^$|'\" \nK\U0001f600-#&~"
TEXT = st.text(ALPHABET, max_size=6)


def sqlite_like(rows, keyword):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE v (i INTEGER, url TEXT, title TEXT)")
    db.executemany("INSERT INTO v VALUES (?, ?, ?)", rows)
    pattern = f"%{keyword}%"
    return {i for (i,) in db.execute("SELECT i FROM v WHERE url LIKE ? OR title LIKE ?", (pattern, pattern))}


def spark_like(spark, rows, keyword, **options):
    frame = spark.createDataFrame(rows, "i int, url string, title string")
    cond = P.keyword_matches(keyword, **options)
    return {r.i for r in (frame if cond is None else frame.filter(cond)).collect()}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.tuples(TEXT, st.none() | TEXT), min_size=40, max_size=80),
    keyword=st.text(ALPHABET, max_size=3),
)
def test_same_rows_as_sqlite(spark, texts, keyword):
    rows = [(i, url, title) for i, (url, title) in enumerate(texts)]
    assert spark_like(spark, rows, keyword) == sqlite_like(rows, keyword)


def test_named_cases(spark):
    rows = [(0, "https://net/", None), (1, "a\\b", ""), (2, "ÄB", "x"), (3, "https://NET/", "T"), (4, "50%", "")]
    for keyword in ("n_t", "a\\b", "äb", "net", "", "%", "_", "50%", "%%", "0\\%", "5%T"):
        assert spark_like(spark, rows, keyword) == sqlite_like(rows, keyword), keyword
    assert spark_like(spark, rows, None) == {0, 1, 2, 3, 4}
    assert spark_like(spark, rows, "NET", case_sensitive=True) == {3}
    assert spark_like(spark, rows, "n_t", case_sensitive=True) == {0}


def test_refine_is_literal_and_unicode(spark):
    rows = [("http://net", None, NOON, 0), ("http://x", "ÄPFEL n_t", NOON + 1, 0)]
    found = search.search_visits(visits(spark, rows), TimeRange(0, 2**42))
    assert [r[0] for r in tuples(search.refine(found, "n_t"))] == ["http://x"]
    assert [r[0] for r in tuples(search.refine(found, "äpfel"))] == ["http://x"]
    assert len(tuples(search.refine(found, ""))) == 2


def test_range_names_the_partition_days_only_when_there_are_some(spark):
    plain = visits(spark, [("u", "t", NOON, 0)])
    span = TimeRange(0, 1)
    assert "visit_day" not in str(P.in_range(plain, span))
    assert "visit_day" in str(P.in_range(plain.withColumn("visit_day", F.current_date()), span))
