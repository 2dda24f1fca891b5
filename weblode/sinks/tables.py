"""Writing tables: clustered layout and snapshot switches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_clustered(df: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Write sorted by ``by`` over range partitions, so scans skip files by their min and max.

    Ranges are cut by sampled rows, not by key, so one scan with most of the documents spans many files.
    """
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("errorifexists").parquet(path)


def _folder(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SnapshotConflict(RuntimeError):
    """Another writer committed in between; read again and repeat the change."""


def _committed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, data folder) of the committed snapshots in order."""
    path, fs = _folder(spark, f"{root}/_log")
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        if status.getLen():  # an empty entry is a commit that has just begun
            stream = fs.open(status.getPath())
            name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((int(status.getPath().getName()), name))
    return sorted(found)


def snapshot_number(spark: SparkSession, root: str) -> int:
    """Number of the newest snapshot; 0 before the first."""
    committed = _committed(spark, root)
    return committed[-1][0] if committed else 0


def write_snapshot(df: DataFrame, root: str, by: list[str] | None = None, base: int | None = None) -> str:
    """Write the next snapshot of a table; readers see it only once it is complete.

    Data goes to a folder of its own, then a log entry that must not exist yet makes it the snapshot after ``base``
    (the newest one when the call begins, if not given).  Of two writers with the same base one is refused with
    ``SnapshotConflict``, so no update is lost.  Old snapshots stay until ``drop_snapshots``.
    """
    spark = df.sparkSession
    number = (snapshot_number(spark, root) if base is None else base) + 1
    name = f"data-{uuid.uuid4().hex}"
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    writer.write.parquet(f"{root}/{name}")
    path, fs = _folder(spark, f"{root}/_log/{number:09d}")
    try:
        entry = fs.create(path, False)
    except Exception as error:
        if fs.exists(path):
            raise SnapshotConflict(f"snapshot {number} of {root} was written by someone else") from error
        raise
    entry.write(bytearray(name.encode()))
    entry.close()
    return f"{root}/{name}"


def read_snapshot(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The newest complete snapshot; an empty table of ``schema`` before the first."""
    committed = _committed(spark, root)
    if not committed:
        if schema is None:
            raise FileNotFoundError(f"no snapshot under {root}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/{committed[-1][1]}")


def drop_snapshots(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the data of all but the newest ``keep`` snapshots; how many went.  Their log entries stay."""
    gone = 0
    for _, name in _committed(spark, root)[: -max(keep, 1)]:
        path, fs = _folder(spark, f"{root}/{name}")
        gone += fs.delete(path, True)
    return gone


def remove_folder(spark: SparkSession, folder: str) -> bool:
    path, fs = _folder(spark, folder)
    return fs.delete(path, True)


def create_table(spark: SparkSession, name: str, schema, location: str | None = None) -> None:
    """Create an empty catalog table unless it is there; missing columns are added, rows are kept."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")
    have = set(spark.table(name).columns)
    missing = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(missing)})")
