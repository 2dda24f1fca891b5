"""Bounded scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.operators.reports import scan_mode, size_stats
from weblode.schemas import HISTORY


def newest(history: DataFrame, limit: int) -> DataFrame:
    """Newest first.  A negative limit means all.  Runs as a per-task top-k, never a full sort."""
    ordered = history.orderBy(F.desc("id"))
    return ordered if limit < 0 else ordered.limit(limit)


def prune(history: DataFrame, keep: int) -> DataFrame:
    """Only the newest ``keep`` rows."""
    return newest(history, keep)


def pruned_away(history: DataFrame, keep: int) -> DataFrame:
    """The rows pruning removes: those not among the newest ``keep``."""
    return history.join(newest(history, keep).select("id"), "id", "left_anti")


def append(history: DataFrame, scans: DataFrame, keep: int) -> DataFrame:
    """Add scans (ids already assigned) and prune."""
    columns = [F.col(f.name).cast(f.dataType) if f.name in scans.columns else F.lit(None).cast(f.dataType) for f in HISTORY]
    new = scans.select(*[c.alias(f.name) for c, f in zip(columns, HISTORY)])
    return prune(history.unionByName(new), keep)


def history_rows(scans: DataFrame, documents: DataFrame) -> DataFrame:
    """History rows of finished scans.

    ``scans``: id, url, crawl_option, max_depth, scan_all_pages, document_filter, pages_scanned,
    scan_error_count, start_time, end_time (seconds), completed_at.  ``documents``: the discovered
    documents with the scan's ``id`` and an order column ``seq``.
    """
    stats = size_stats(documents, ["id"]).drop("has_retryable_errors")
    joined = scans.join(stats, "id", "left")
    zero_filled = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("documents_found", "document_error_count")}
    return joined.withColumns(
        zero_filled
        | {
            "scan_mode": scan_mode(F.col("crawl_option"), F.col("scan_all_pages")),
            "duration_seconds": F.col("end_time") - F.col("start_time"),
        }
    ).drop("scan_all_pages", "start_time", "end_time")
