"""CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.operators.reports import export_rows

CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n"}


def export_scan(store: DataFrame, scan_url: str, path: str, single_file: bool = False) -> None:
    """Write a scan's export table as CSV with CRLF line ends, in parts sorted in order of their names.

    ``single_file`` asks for one file, written by one task; choose it for scans one task can write.
    """
    rows = export_rows(store.filter(F.col("scan_url") == scan_url))
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
