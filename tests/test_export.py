import csv
from pathlib import Path

from helpers import NOON, visits
from visitlake.functions.ranges import TimeRange
from visitlake.sources.export import export_csv


def test_csv_is_rfc_4180_and_in_time_order(spark, tmp_path):
    titles = [" pad ", 'say "hi", ok', "two\nlines", "cr\rhere", "back\\slash", 'q\\"', "#hash", "", None, "ü\t", '"', "a;b"]
    rows = [(f'http://u,"{i}"', t, NOON + i * 1_000_000, i) for i, t in enumerate(titles)]
    frame = visits(spark, rows).repartition(3)
    folder = tmp_path / "out"
    for _ in range(2):  # the second run replaces the first
        export_csv(frame, TimeRange(0, 2**42), str(folder))
    got = []
    for part in sorted(folder.glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as lines:
            reader = csv.reader(lines, strict=True)
            assert next(reader) == ["time", "title", "url", "visit_type"]
            got += list(reader)
    want = [[f"2024-01-15 12:00:{i:02}", t or "", f'http://u,"{i}"', str(i)] for i, t in enumerate(titles)]
    assert got == want


def test_line_format(spark, tmp_path):
    export_csv(visits(spark, [('http://u,"q"', " pad ", NOON, 0)]), TimeRange(0, 2**42), str(tmp_path / "o"))
    (part,) = [p for p in Path(tmp_path / "o").glob("part-*.csv") if p.stat().st_size]
    assert part.read_text() == 'time,title,url,visit_type\n2024-01-15 12:00:00, pad ,"http://u,""q""",0\n'


def test_compat_types(spark, tmp_path):
    export_csv(visits(spark, [("u", "t", NOON, 7)]), TimeRange(0, 2**42), str(tmp_path / "o"), compat=True)
    text = "".join(p.read_text() for p in Path(tmp_path / "o").glob("part-*.csv"))
    assert text.splitlines()[-1] == "2024-01-15 12:00:00,t,u,0"
