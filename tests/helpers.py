"""Small frames and a plain SQLite model of the backup to compare with."""

from __future__ import annotations

import sqlite3

from visitlake import schema

DAY_US = 86_400_000_000
NOON = 1_705_320_000_000_000  # 2024-01-15 12:00:00 UTC


def visits(spark, rows):
    """Stored visits from (url, title, visit_time, visit_type[, browser, path])."""
    full = [
        (r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "chrome", r[5] if len(r) > 5 else "/p") for r in rows
    ]
    names = ["url", "title", "visit_time", "visit_type", "browser", "data_path"]
    layout = schema.VISITS
    return spark.createDataFrame(full, layout.__class__([f for f in layout if f.name in names]))


def found(spark, rows):
    return spark.createDataFrame(rows, schema.FOUND_VISITS)


def tuples(frame):
    return [tuple(row) for row in frame.collect()]


def plan_nodes(node):
    """All nodes of an executed plan, whatever adaptive execution wraps them in."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from plan_nodes(node.executedPlan())
        return
    yield node
    if name.endswith("QueryStage"):
        yield from plan_nodes(node.plan())
    for i in range(node.children().size()):
        yield from plan_nodes(node.children().apply(i))


def scanned(frame, metric="numFiles"):
    """How many files, or by another metric rows, the frame's scans have read."""
    frame.collect()
    scans = [n for n in plan_nodes(frame._jdf.queryExecution().executedPlan()) if "Scan" in n.nodeName()]
    metrics = [n.metrics().get(metric) for n in scans]
    return sum(m.get().value() for m in metrics if m.isDefined())


class ModelStore:
    """What a row-by-row backup into one SQLite file leaves behind."""

    def __init__(self):
        self.db = sqlite3.connect(":memory:")
        self.db.executescript(
            "CREATE TABLE pages (id INTEGER PRIMARY KEY, url TEXT UNIQUE, title TEXT);"
            "CREATE TABLE hits (page INTEGER, t INTEGER, kind INTEGER, path TEXT, UNIQUE (page, t));"
            "CREATE TABLE imports (path TEXT PRIMARY KEY, t INTEGER)"
        )
        self.imported = self.duplicated = 0

    def add_file(self, path, rows):
        """rows: (url, title, t, kind) in file order."""
        rows = sorted(rows, key=lambda r: r[2])
        for url, title, t, kind in rows:
            self.db.execute("INSERT OR IGNORE INTO pages (url, title) VALUES (?, ?)", (url, title))
            cursor = self.db.execute(
                "INSERT OR IGNORE INTO hits SELECT id, ?, ?, ? FROM pages WHERE url = ?", (t, kind, path, url)
            )
            self.imported += cursor.rowcount
            self.duplicated += 1 - cursor.rowcount
        if rows:
            self.db.execute("INSERT OR REPLACE INTO imports VALUES (?, ?)", (path, rows[-1][2]))

    def visits(self):
        return sorted(self.db.execute("SELECT url, title, t, kind, path FROM hits JOIN pages ON page = id"))

    def imports(self):
        return sorted(self.db.execute("SELECT path, t FROM imports"))
