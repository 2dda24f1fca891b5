"""Progress and status as Structured Streaming queries.

Counters and states are built-in streaming aggregations: state stays in Spark's state store and
results follow in update or complete mode.  There is no event time and no late data here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblode.operators.enrich import status_from_events
from weblode.session import scratch_path


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, **options) -> DataFrame:
    """New files of a folder as a stream of rows."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def progress_counts(outcomes: DataFrame, keys: list[str], succeeded: str = "succeeded", size: str | None = None) -> DataFrame:
    """Running ``completed``, ``failed`` and ``total_bytes`` per key of a stream of outcomes."""
    ok = F.col(succeeded)
    amounts = [F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed")]
    if size:
        amounts.append(F.coalesce(F.sum(F.when(ok, F.col(size))), F.lit(0)).alias("total_bytes"))
    return outcomes.groupBy(*keys).agg(*amounts)


def live_status(events: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """Current summary status per document of an event stream; the same fold as the batch form."""
    return status_from_events(events, key, order)


def run_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    mode: str = "update",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Process what is there, batch by batch, and stop.  The checkpoint makes the next run go on from here."""
    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", place)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its last result, written to the shared folder.

    In complete mode every micro-batch holds the whole result; each is written to its own folder and
    the newest complete one is the answer.
    """
    spark = stream.sparkSession
    place = scratch_path(spark, "stream-result")

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated micro-batch overwrites its own folder: the write is idempotent.
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    run_available(stream, keep, mode)
    written = spark.read.parquet(place)
    newest = written.agg(F.max("batch")).scalar()
    return written.filter(F.col("batch") == newest).drop("batch")
