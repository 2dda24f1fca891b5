"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job here relies on.  Only semantics-bearing ones are forced: timestamps are read
#: and written in UTC, and adaptive execution splits skewed joins and sizes reducers at run time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Folders chosen for local sessions without the setting, by application.
_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "weblode", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session.  ``conf`` keys use ``__`` for dots: ``spark__sql__shuffle__partitions="64"``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def working_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent a folder is chosen only for a local master.  On a cluster a
    machine-local folder would be lost with its executor, so the job is refused instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        # The setting can't be changed in a running session, so the folder is remembered here.
        application = spark.sparkContext.applicationId
        if application not in _local_dirs:
            import tempfile

            _local_dirs[application] = tempfile.mkdtemp(prefix="weblode-")
        return _local_dirs[application]
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS or an object store)")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared working folder."""
    return f"{working_dir(spark)}/weblode/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss.

    A parquet table is used rather than ``checkpoint()`` because it is columnar (later steps read
    only the columns they need) and carries a real size, which is what Spark checks before it
    decides to broadcast a side.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    # The schema is known: no job to infer it.
    return df.sparkSession.read.schema(df.schema).parquet(path)
