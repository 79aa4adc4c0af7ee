"""CSV export of the visit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions import scalars
from visitlake.functions.ranges import TimeRange
from visitlake.operators.search import search_visits


def export_rows(visits: DataFrame, span: TimeRange, compat: bool = False) -> DataFrame:
    """The lines of the export, in time order."""
    return search_visits(visits, span, compat=compat).select(
        scalars.ms_to_ymdhms(F.col("visit_ms")).alias("time"), "title", "url", "visit_type"
    )


def export_csv(visits: DataFrame, span: TimeRange, folder: str, compat: bool = False) -> None:
    """Write the export as RFC 4180 CSV, replacing the folder.

    The part files are in time order by name; every part has the header line.
    """
    (
        export_rows(visits, span, compat)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
