"""Scratch tables dealt into hash buckets of one column, so that joins on it leave them where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.session import scratch_path


class BucketedTable:
    """A table that grows by :meth:`append`, in ``count`` buckets of ``by`` and, if given, partitions of ``part``.

    A join on ``by`` moves the other side only.  ``count`` is at least the session's shuffle partitions: with fewer
    Spark would deal both sides anew.  Files lie in the shared folder; the catalog knows the table by a random name
    until :meth:`drop`, which leaves the files.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str, by: str, count: int | None = None, part: str | None = None):
        self.spark, self.by = spark, by
        self.count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count or 1)
        self.name, self.path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", scratch_path(spark, name)
        partitioned = f" PARTITIONED BY (`{part}`)" if part else ""
        spark.sql(
            f"CREATE TABLE {self.name} ({schema}) USING parquet{partitioned} CLUSTERED BY (`{by}`) INTO {self.count} BUCKETS LOCATION '{self.path}'"
        )
        self.columns = spark.table(self.name).columns

    def append(self, df: DataFrame) -> None:
        """Add rows; each task writes one bucket."""
        df.select(self.columns).repartition(self.count, F.col(self.by)).write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def bucketed(df: DataFrame, name: str, by: str, count: int | None = None) -> DataFrame:
    """``df`` written once and read back in buckets of ``by``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table = BucketedTable(df.sparkSession, name, schema, by, count)
    table.append(df)
    return table.read()
