"""Progress of long jobs as running counters, and their events as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.sizes import format_size
from weblode.functions.text import preview
from weblode.operators.ordered import ordinals, running_totals


def size_progress(sizes: DataFrame, order: str = "seq", column: str = "size_bytes") -> DataFrame:
    """After each probed file: ``completed, total, known_count, total_bytes, total_display``.

    The overall count is a scalar subquery, not a window over everything.
    """
    marked = sizes.withColumns({
        "_one": F.lit(1).cast("bigint"),
        "_known": F.col(column).isNotNull().cast("bigint"),
        "_size": F.coalesce(F.col(column), F.lit(0)).cast("bigint"),
    })
    run = running_totals(marked, order, ["_one", "_known", "_size"])
    total = sizes.agg(F.count("*")).scalar()
    return run.select(
        *sizes.columns,
        F.col("_one_running").alias("completed"),
        total.alias("total"),
        F.col("_known_running").alias("known_count"),
        F.col("_size_running").alias("total_bytes"),
        format_size(F.col("_size_running")).alias("total_display"),
    )


def download_progress(files: DataFrame, order: str = "seq", succeeded: str = "succeeded") -> DataFrame:
    """Before each file starts: its index, the total, and how many completed and failed so far."""
    marked = files.withColumns({
        "_one": F.lit(1).cast("bigint"),
        "_ok": F.col(succeeded).cast("bigint"),
        "_bad": (~F.col(succeeded)).cast("bigint"),
    })
    run = running_totals(marked, order, ["_one", "_ok", "_bad"])
    total = files.agg(F.count("*")).scalar()
    return run.select(
        *files.columns,
        F.col("_one_running").alias("current_file_index"),
        total.alias("total_files"),
        (F.col("_ok_running") - F.col("_ok")).alias("files_completed"),
        (F.col("_bad_running") - F.col("_bad")).alias("files_failed"),
        F.concat(F.lit("Downloading "), F.col("filename"), F.lit("...")).alias("message"),
    )


def download_summary(files: DataFrame, succeeded: str = "succeeded") -> DataFrame:
    """The closing event of a download."""
    counted = files.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col(succeeded)).alias("files_completed"),
        F.count_if(~F.col(succeeded)).alias("files_failed"),
    )
    text = F.format_string("Downloaded %d files, %d failed", "files_completed", "files_failed")
    return counted.withColumn("message", text)


def remaining_after(df: DataFrame, flag: Column, order: str = "seq", name: str = "remaining") -> DataFrame:
    """Rows with ``flag`` that come after the current one: the overall count less the running count."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    total = marked.agg(F.coalesce(F.sum("_flag"), F.lit(0))).scalar()
    run = running_totals(marked, order, ["_flag"])
    return run.withColumn(name, total - F.col("_flag_running")).drop("_flag", "_flag_running")


def numbered(df: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``ordinal`` and the ``total`` row count."""
    total = df.agg(F.count("*")).scalar()
    return ordinals(df, order).withColumn("total", total)


def size_event(progress: DataFrame, url: str = "url") -> DataFrame:
    """``event, data`` rows for a size calculation: JSON text per progress step."""
    payload = F.struct(
        "completed", "total", preview(F.col(url), 50).alias("current_url"), "known_count", "total_bytes", "total_display"
    )
    return progress.select(F.lit("progress").alias("event"), F.to_json(payload).alias("data"))


def json_event(event: Column | str, *fields: Column | str) -> Column:
    """``struct(event, data)`` with the fields as one JSON object; null fields are kept."""
    name = event if isinstance(event, Column) else F.lit(event)
    return F.struct(
        name.alias("event"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("data")
    )
