"""Reports over scans and the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.sizes import format_duration, format_size, format_size_history, relative_day
from weblode.functions.text import or_else
from weblode.functions.url import display_host_path
from weblode.lookups import (
    EXPORT_HEADER,
    FILTER_SHORT_NAMES,
    MISSING_SUMMARY,
    MISSING_TITLE,
    MODE_NAMES,
    SUMMARY_STATUSES,
    lookup,
)


def status_counts(store: DataFrame, by_scan: bool = False) -> DataFrame:
    """Documents per summary status, every known status present, unknown ones left out.

    Counting and zero-filling are one aggregation: the four statuses are conditional counts, turned
    into rows afterwards.
    """
    counted = store.groupBy(*(["scan_url"] if by_scan else [])).agg(
        *[F.count_if(F.col("summary_status") == status).alias(status) for status in SUMMARY_STATUSES]
    )
    return counted.unpivot(
        ["scan_url"] if by_scan else [], SUMMARY_STATUSES, "summary_status", "documents"
    )


def scans_overview(store: DataFrame) -> DataFrame:
    """``scan_url, document_count, latest_download`` (ISO text), latest first."""
    grouped = store.groupBy("scan_url").agg(
        F.count("*").alias("document_count"), F.max("downloaded_at").alias("latest")
    )
    return grouped.orderBy(F.desc("latest"), "scan_url").select(
        "scan_url",
        "document_count",
        F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss").alias("latest_download"),
    )


def extensions(store: DataFrame, scan_url: str | None = None) -> DataFrame:
    rows = store if not scan_url else store.filter(F.col("scan_url") == scan_url)
    return rows.select("extension").distinct().orderBy("extension")


def extensions_by_scan(store: DataFrame) -> DataFrame:
    return store.select("scan_url", "extension").distinct().orderBy("scan_url", "extension")


def failed_details(store: DataFrame, scan_url: str) -> DataFrame:
    """Failed summaries of a scan with their errors, by file name."""
    failed = (F.col("scan_url") == scan_url) & (F.col("summary_status") == "failed")
    return store.filter(failed).select("_id", "filename", "summary_error", "extension").orderBy("filename", "_id")


def scan_mode(crawl_option: Column, scan_all_pages: Column) -> Column:
    return F.when(
        crawl_option == "follow", F.when(scan_all_pages, F.lit("continuous")).otherwise(F.lit("batch"))
    ).otherwise(F.lit("single page"))


def size_stats(documents: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Per scan: document counts and the sum, largest and smallest of the known, positive sizes.

    The first document in ``order`` wins ties.  All parts are mergeable aggregates.
    """
    size = F.col("file_size_bytes")
    sized = size > 0
    biggest = F.when(sized, F.struct(size, -F.col(order)))
    smallest = F.when(sized, F.struct(size, F.col(order)))
    return documents.groupBy(*keys).agg(
        F.count("*").alias("documents_found"),
        F.count_if(~F.col("is_accessible")).alias("document_error_count"),
        F.bool_or(~F.col("is_accessible")).alias("has_retryable_errors"),
        F.sum(F.when(sized, size)).alias("total_size_bytes"),
        F.max_by("filename", biggest).alias("largest_file_name"),
        F.max(F.when(sized, size)).alias("largest_file_size"),
        F.min_by("filename", smallest).alias("smallest_file_name"),
        F.min(F.when(sized, size)).alias("smallest_file_size"),
    )


def size_totals(sizes: DataFrame, column: str = "size_bytes") -> DataFrame:
    """One row: known and unknown counts and the total, 0 when nothing is known."""
    size = F.col(column)
    totals = sizes.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.count(size).alias("known_count"),
        F.count_if(size.isNull()).alias("unknown_count"),
    )
    return totals.withColumn("total_display", format_size(F.col("total_bytes")))


def scan_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The 13-field summary of each scan: its request joined with what its result counted.

    ``requests``: session_id, url, crawl_option, max_depth, document_type_filter, scan_all_pages,
    start_time, end_time.  ``results``: session_id, pages_scanned, pages_remaining, scan_error_count,
    documents_found, document_error_count, failed_pages.  Scans without a result show zeros.
    """
    rows = requests.join(results, "session_id", "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)

    duration = F.col("end_time") - F.col("start_time")
    return rows.select(
        "session_id",
        "url",
        "crawl_option",
        "max_depth",
        F.col("document_type_filter").alias("document_filter"),
        "scan_all_pages",
        count("pages_scanned"),
        count("documents_found"),
        duration.alias("duration_seconds"),
        (F.coalesce(F.col("pages_remaining"), F.lit(0)) > 0).alias("has_more_pages"),
        count("pages_remaining"),
        count("scan_error_count"),
        count("document_error_count"),
        (F.coalesce(F.col("document_error_count"), F.lit(0)) + F.coalesce(F.col("failed_pages"), F.lit(0)) > 0).alias(
            "has_retryable_errors"
        ),
    )


def export_sort_key() -> Column:
    return F.lower(or_else(or_else(F.col("title"), F.col("filename")), ""))


def export_rows(store: DataFrame, scan_url: str | None = None) -> DataFrame:
    """The export table of one scan (or of all): six text columns, by title or else file name.

    A global sort over range partitions; ``sinks.exports`` writes it.
    """
    rows = store if scan_url is None else store.filter(F.col("scan_url") == scan_url)
    ordered = rows.select(
        export_sort_key().alias("_key"), "title", "short_summary", "source_url", "filename", "file_type_label",
        "version_label",
    ).orderBy("_key", "filename", "source_url")
    values = [
        or_else(F.col("title"), MISSING_TITLE),
        or_else(F.col("short_summary"), MISSING_SUMMARY),
        *[or_else(F.col(name), "") for name in ("source_url", "filename", "file_type_label", "version_label")],
    ]
    return ordered.select(*[value.alias(name) for name, value in zip(EXPORT_HEADER, values)])


def history_view(history: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The history list as shown: labels, display sizes, error totals, a dash for what does not apply."""
    zero = F.lit(0)
    columns = [
        "id",
        display_host_path(F.col("url"), 40).alias("url"),
        lookup(MODE_NAMES, F.col("scan_mode"), F.col("scan_mode")).alias("mode"),
        lookup(FILTER_SHORT_NAMES, F.col("document_filter"), F.col("document_filter")).alias("filter"),
        F.when(F.col("crawl_option") == "single", F.lit("-")).otherwise(F.col("max_depth").cast("string")).alias("depth"),
        F.coalesce(F.col("pages_scanned"), zero).alias("pages"),
        F.coalesce(F.col("documents_found"), zero).alias("documents"),
        F.coalesce(format_duration(F.col("duration_seconds")), F.lit("-")).alias("duration"),
        (F.coalesce(F.col("scan_error_count"), zero) + F.coalesce(F.col("document_error_count"), zero)).alias("errors"),
        F.when(F.coalesce(F.col("total_size_bytes"), zero) != 0, format_size_history(F.col("total_size_bytes")))
        .otherwise(F.lit("-"))
        .alias("size"),
    ]
    if as_of is not None:
        columns.append(F.coalesce(relative_day(F.col("completed_at"), as_of), F.lit("-")).alias("date"))
    return history.select(*columns)


def visible_documents(documents: DataFrame, hide_inaccessible: bool = True, text: str = "") -> DataFrame:
    """Result-list filter: accessible documents whose name or type contains the text."""
    rows = documents.filter("is_accessible") if hide_inaccessible else documents
    if text:
        needle = text.lower()
        rows = rows.filter(
            F.contains(F.lower("filename"), F.lit(needle)) | F.contains(F.lower("extension"), F.lit(needle))
        )
    return rows


def result_page(documents: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of an ordered result; a per-task top-k of the rows up to its end."""
    return documents.orderBy(*order).offset((page - 1) * size).limit(size)


def inaccessible_log(failures: DataFrame, order: str = "seq") -> DataFrame:
    """One ``reason | url`` line per URL: its first failure in ``order``."""
    first = failures.groupBy("url").agg(F.min_by("reason", order).alias("reason"), F.min(order).alias(order))
    return first.select(order, "url", F.concat_ws(" | ", "reason", "url").alias("line"))


def recent_urls(visits: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """Most recently used distinct URLs, newest first."""
    return visits.groupBy("url").agg(F.max(order).alias("last_used")).orderBy(F.desc("last_used"), "url").limit(limit)


def retry_workload(documents: DataFrame, failed_pages: DataFrame) -> DataFrame:
    """What a retry would request: inaccessible documents and failed pages, with their ``kind``."""
    docs = documents.filter(~F.col("is_accessible")).select("url", "depth", F.lit("document").alias("kind"))
    return docs.unionByName(failed_pages.select("url", "depth", F.lit("page").alias("kind")))
