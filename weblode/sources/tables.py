"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` as a DataFrame; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, by: str, each: int) -> DataFrame:
    """Narrow rows dealt over tasks of about ``each`` rows, for work that is long per row.

    Scans deal out files by their bytes, and adaptive execution shuffles by theirs: many rows of little size would share
    a few tasks.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), by)


def health(df_source) -> dict:
    """Connection check: ``connected, message, document_count`` from a callable that opens the store."""
    from pyspark.sql import functions as F

    from weblode.functions.errors import connection_error_message

    try:
        store = df_source()
        count = store.count()
        return {"connected": True, "message": f"Connected ({count} documents stored)", "document_count": count}
    except Exception as error:  # the check reports whatever went wrong
        spark = SparkSession.active()
        text = spark.range(1).select(connection_error_message(F.lit(str(error)))).first()[0]
        return {"connected": False, "message": text, "document_count": 0}
