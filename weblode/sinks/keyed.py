"""Tables with changing rows: change files by key bucket, one commit log for several tables, compaction by bucket.

A table's rows are dealt into buckets by a hash of their key.  A change writes only the rows that change, as parquet in
a folder of its own with one subfolder per bucket, and a log entry makes it part of the table.  Reading a bucket without
changes since its last compaction is a plain scan; in a changed bucket the older versions of changed keys are left out
by an anti join with the changed keys, so what is shuffled or broadcast follows the changes, not the table.

The log is shared: an entry may change several tables, and readers see all of it or nothing.  An entry's number must not
exist yet, so of two writers one is refused; it tries again by itself if the other one changed other buckets, and raises
``SnapshotConflict`` if both read and changed the same one.  Data that no entry names, such as a lost writer's, is never
read, and :meth:`KeyedTables.vacuum` removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.sinks.tables import SnapshotConflict, _folder

#: A log entry of a multiple of this number carries the whole state, so that readers go back no further.
FULL_ENTRY = 20


@dataclass(frozen=True)
class Layout:
    """``key`` names a row; ``bucket_by`` is SQL over it (rows to be found together); ``order`` sorts within files."""

    schema: T.StructType
    key: str
    bucket_by: str | None = None
    order: tuple[str, ...] = ()


@dataclass
class Change:
    """Rows to insert or replace, and keys to delete (a column named as the table's key); either may be None."""

    rows: DataFrame | None = None
    deleted: DataFrame | None = None


@dataclass
class Bucket:
    """Folders that hold a bucket: the last compacted one, and the changes after it."""

    base: str | None = None
    changes: list[str] = field(default_factory=list)


State = dict[str, dict[int, Bucket]]


class KeyedTables:
    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout], buckets: int = 64):
        """``buckets`` counts when the first change is committed, and stays."""
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), layouts
        self._wanted = buckets

    # --- the log ------------------------------------------------------------------------------

    def _entries(self) -> list[int]:
        path, fs = _folder(self.spark, f"{self.root}/_log")
        if not fs.exists(path):
            return []
        # An empty entry is a commit that has just begun.
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getLen())

    def _entry(self, number: int) -> dict:
        path, fs = _folder(self.spark, f"{self.root}/_log/{number:09d}")
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def version(self) -> int:
        """Number of the newest commit; 0 before the first."""
        return max(self._entries(), default=0)

    def state(self, version: int | None = None) -> tuple[int, int, State]:
        """(commit, number of buckets, folders by table and bucket) as of a commit, the newest if not given."""
        numbers = [n for n in self._entries() if version is None or n <= version]
        todo, count, state = [], self._wanted, {name: {} for name in self.layouts}
        for number in reversed(numbers):
            entry = self._entry(number)
            if "state" in entry:
                state = {t: {int(b): Bucket(*v) for b, v in found.items()} for t, found in entry["state"].items()}
                count = entry["buckets"]
                break
            todo.append(entry)
        for entry in reversed(todo):
            count = entry["buckets"]
            _apply(state, entry["actions"])
        return (numbers[-1] if numbers else 0), count, state

    def _touched_since(self, version: int) -> set[tuple[str, int]]:
        since = [self._entry(n)["actions"] for n in self._entries() if n > version]
        return {(a["table"], b) for actions in since for a in actions for b in a["buckets"]}

    # --- reading ------------------------------------------------------------------------------

    def bucket_of(self, table: str, count: int) -> Column:
        layout = self.layouts[table]
        return F.pmod(F.xxhash64(F.expr(layout.bucket_by or f"`{layout.key}`")), F.lit(count)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets that hold the given keys (a column named as the table's key): at most as many as there are."""
        _, count, _ = self.state()
        return sorted(r[0] for r in keys.select(self.bucket_of(table, count)).distinct().collect())

    def _scan(self, table: str, folders: Iterable[tuple[str, int]]) -> DataFrame:
        """Rows of the given (folder, bucket) pairs, with ``_commit`` and ``_deleted``."""
        schema = T.StructType([*self.layouts[table].schema.fields, *_OWN])
        places = [f"{self.root}/{table}/_change={name}/_bucket={bucket}" for name, bucket in folders]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*places).select(schema.names)

    def read(self, table: str, buckets: Iterable[int] | None = None, keys: list | None = None, version: int | None = None) -> DataFrame:
        """The table's rows, or those of some buckets or keys.

        A list of keys reads their buckets only, and the keys reach the scan one by one, where the files' Bloom filters
        pass over row groups without them.
        """
        layout = self.layouts[table]
        _, count, state = self.state(version)
        wanted: Column | None = None
        if keys is not None:
            rows = self.spark.createDataFrame([(k,) for k in keys], T.StructType([layout.schema[layout.key]]))
            buckets = [r[0] for r in rows.select(self.bucket_of(table, count)).distinct().collect()]
            wanted = reduce(lambda a, b: a | b, [F.col(layout.key) == k for k in keys if k is not None], F.lit(False))
        found = {b: s for b, s in state[table].items() if buckets is None or b in set(buckets)}

        def scan(folders: list[tuple[str, int]]) -> DataFrame:
            rows = self._scan(table, folders)
            return rows if wanted is None else rows.filter(wanted)

        clean = scan([(s.base, b) for b, s in found.items() if s.base and not s.changes])
        changed = {b: s for b, s in found.items() if s.changes}
        if not changed:
            return clean.select(layout.schema.names)
        old = scan([(s.base, b) for b, s in changed.items() if s.base])
        news = scan([(name, b) for b, s in changed.items() for name in s.changes])
        last = news.groupBy(layout.key).agg(F.max("_commit").alias("_last_commit")).withColumnRenamed(layout.key, "_changed_key")
        same = F.col(layout.key).eqNullSafe(F.col("_changed_key"))
        newest = news.join(last, same & (F.col("_commit") == F.col("_last_commit")), "left_semi").filter("NOT _deleted")
        kept = old.join(last, same, "left_anti")
        return clean.unionByName(kept).unionByName(newest).select(layout.schema.names)

    # --- writing ------------------------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame, count: int) -> dict | None:
        """Write rows with their marks to a new folder; what the log says of it, or None if there were none.

        Small buckets share a task, and a bucket of any size is split over several files.
        """
        layout = self.layouts[table]
        name = uuid.uuid4().hex
        place = f"{self.root}/{table}/_change={name}"
        dealt = rows.withColumn("_bucket", self.bucket_of(table, count)).hint("rebalance", "_bucket")
        (
            dealt.sortWithinPartitions("_bucket", *layout.order, layout.key)
            .write.partitionBy("_bucket")
            .option(f"parquet.bloom.filter.enabled#{layout.key}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(place)
        )
        path, fs = _folder(self.spark, place)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        touched = sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))
        return {"table": table, "kind": "change", "name": name, "buckets": touched} if touched else None

    def commit(self, changes: dict[str, Change], base: int | None = None) -> int:
        """Make the changes of one or more tables visible together; the commit's number.

        ``base`` is the commit that the changes were computed from (the newest, if not given).  Keys must be unique
        within a change's rows; a key both written and deleted is deleted.
        """
        newest, count, _ = self.state()
        base = newest if base is None else base
        actions = []
        for table, change in changes.items():
            layout, parts = self.layouts[table], []
            if change.rows is not None:
                rows = change.rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in layout.schema])
                if change.deleted is not None:
                    gone = change.deleted.select(F.col(layout.key).alias("_gone"))
                    rows = rows.join(gone, F.col(layout.key).eqNullSafe(F.col("_gone")), "left_anti")
                parts.append(rows.withColumn("_deleted", F.lit(False)))
            if change.deleted is not None:
                marks = change.deleted.select(F.col(layout.key).alias("_gone")).distinct()
                values = [(F.col("_gone") if f.name == layout.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout.schema]
                parts.append(marks.select(*values, F.lit(True).alias("_deleted")))
            if parts:
                rows = reduce(DataFrame.unionByName, parts)
                done = self._write(table, rows.withColumn("_commit", F.lit(base + 1).cast("bigint")), count)
                actions += [done] if done else []
        return self._log(actions, base, count) if actions else base

    def compact(self, table: str, buckets: Iterable[int] | None = None, least: int = 1) -> list[int]:
        """Rewrite buckets that have at least ``least`` changes (all such, or those given); which ones were.

        Only those buckets are read and written.  Deletion marks and replaced rows end here.
        """
        version, count, state = self.state()
        worth = [b for b, s in state[table].items() if len(s.changes) >= least and (buckets is None or b in set(buckets))]
        if not worth:
            return []
        rows = self.read(table, worth, version=version)
        marked = rows.withColumns({"_deleted": F.lit(False), "_commit": F.lit(version).cast("bigint")})
        done = self._write(table, marked, count) or {"table": table, "name": None}
        # Buckets whose rows are all deleted have no folder and no base any more.
        held = done.get("buckets", [])
        actions = [{"table": table, "kind": "base", "name": done["name"], "buckets": worth, "held": held}]
        self._log(actions, version, count)
        return sorted(worth)

    def _log(self, actions: list[dict], base: int, count: int) -> int:
        mine = {(a["table"], b) for a in actions for b in a["buckets"]}
        number = base + 1
        while True:
            if mine & self._touched_since(base):
                raise SnapshotConflict(f"{self.root}: the same buckets were changed by someone else")
            entry = {"buckets": count, "actions": actions}
            if number % FULL_ENTRY == 0:
                _, _, state = self.state(number - 1)
                _apply(state, actions)
                entry["state"] = {t: {b: [s.base, s.changes] for b, s in found.items()} for t, found in state.items()}
            path, fs = _folder(self.spark, f"{self.root}/_log/{number:09d}")
            try:
                stream = fs.create(path, False)
            except Exception:
                if not fs.exists(path):
                    raise
                self._await(number)
                number += 1
                continue
            stream.write(bytearray(json.dumps(entry).encode()))
            stream.close()
            return number

    def _await(self, number: int, seconds: float = 30.0) -> None:
        """Wait until an entry that someone has begun is written."""
        end = time.monotonic() + seconds
        while number not in self._entries():
            if time.monotonic() > end:
                raise SnapshotConflict(f"{self.root}: commit {number} was begun and not finished")
            time.sleep(0.1)

    def vacuum(self, older_than: float = 7 * 86_400.0) -> int:
        """Delete folders the newest state doesn't name and that were last changed so many seconds ago; how many.

        The age protects writers that haven't committed yet and readers of earlier commits.
        """
        _, _, state = self.state()
        gone, limit = 0, (time.time() - older_than) * 1000
        for table, found in state.items():
            used = {name for s in found.values() for name in (s.base, *s.changes)}
            path, fs = _folder(self.spark, f"{self.root}/{table}")
            for status in fs.listStatus(path) if fs.exists(path) else []:
                if status.getPath().getName().partition("=")[2] not in used and status.getModificationTime() <= limit:
                    gone += fs.delete(status.getPath(), True)
        return gone


_OWN = [T.StructField("_commit", T.LongType()), T.StructField("_deleted", T.BooleanType())]


def _apply(state: State, actions: list[dict]) -> None:
    """Carry a log entry's actions into a state."""
    for action in actions:
        for number in action["buckets"]:
            bucket = state[action["table"]].setdefault(number, Bucket())
            if action["kind"] == "change":
                bucket.changes.append(action["name"])
            else:
                bucket.base, bucket.changes = (action["name"] if number in action["held"] else None), []
