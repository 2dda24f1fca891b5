"""Paid calls that are made once: an outbox of requests by idempotency key, drained by one owner at a time.

A request is a row before it is sent.  Its key is a digest of the document and the request, so the same request put in
twice is one row, and a task that is repeated after a lost executor posts under the key it used before, by which the
service knows the call.  Replies are committed bucket by bucket before the next bucket is sent: a lost driver repeats
at most the calls of one part, under their old keys.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.schemas import CALL
from weblode.session import materialize
from weblode.sinks.keyed import Change, KeyedTables, Layout
from weblode.sinks.tables import _folder
from weblode.sources.services import REPLY_ROW

#: Statuses of an answer that are worth another try.
RETRYABLE = (408, 429, 500, 502, 503, 504)

#: Replies that a task holds before it hands them on.
REPLIES = 1_000


class Busy(RuntimeError):
    """Someone else holds the lease."""


class Lease:
    """A file that only one owner can create; one that has expired may be taken over."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600.0):
        self.spark, self.path, self.seconds, self.owner = spark, path, seconds, uuid.uuid4().hex

    def _held_until(self) -> float:
        path, fs = _folder(self.spark, self.path)
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        # A lease that is just being written counts as held.
        return float(text.partition(" ")[2]) if " " in text else fs.getFileStatus(path).getModificationTime() / 1000 + self.seconds

    def __enter__(self) -> Lease:
        path, fs = _folder(self.spark, self.path)
        for _ in range(2):
            try:
                stream = fs.create(path, False)
            except Exception:
                if not fs.exists(path):
                    continue
                if self._held_until() > time.time():
                    raise Busy(f"{self.path} is held by another owner") from None
                fs.delete(path, False)
                continue
            stream.write(bytearray(f"{self.owner} {time.time() + self.seconds}".encode()))
            stream.close()
            return self
        raise Busy(f"{self.path} was taken by another owner")

    def __exit__(self, *error) -> None:
        path, fs = _folder(self.spark, self.path)
        fs.delete(path, False)


class Outbox:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, attempts: int = 3):
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts
        self.tables = KeyedTables(spark, f"{self.root}/calls", {"calls": Layout(CALL, "call_key")}, buckets)

    def calls(self) -> DataFrame:
        return self.tables.read("calls")

    def put(self, requests: DataFrame) -> int:
        """Add ``_id, request`` rows that aren't there yet; the commit's number."""
        base = self.tables.version()
        key = F.sha2(F.concat_ws("\n", F.coalesce("_id", F.lit("\0")), "request"), 256)
        keyed = materialize(requests.select(key.alias("call_key"), "_id", "request").dropDuplicates(["call_key"]), "outbox-new")
        known = self.tables.read("calls", self.tables.buckets_of("calls", keyed), version=base).select("call_key")
        fresh = keyed.join(known, "call_key", "left_anti")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in CALL if f.name not in ("call_key", "_id", "request")}
        rows = fresh.withColumns(empty).withColumns({"state": F.lit("waiting"), "attempts": F.lit(0)})
        return self.tables.commit({"calls": Change(rows)}, base)

    def drain(self, post: Callable[[str, str], dict], parallel: int = 4, gap: float = 0.0, part: int = 4, pause=time.sleep) -> int:
        """Send what waits, ``part`` buckets at a time, until nothing is left to try; how many calls were made.

        ``post(request, key)`` answers with a reply's parts.  Answers worth another try wait for it, up to the number
        of attempts.  Only one owner drains at a time: another one gets :class:`Busy`.
        """
        made = 0
        with Lease(self.spark, f"{self.root}/lease"):
            for attempt in range(self.attempts):
                if attempt:
                    pause(2.0**attempt)
                sent = 0
                _, _, state = self.tables.state()
                numbers = sorted(state["calls"])
                for at in range(0, len(numbers), part):
                    sent += self._send(numbers[at : at + part], post, parallel, gap, attempt)
                made += sent
                if not sent:
                    break
        return made

    def _send(self, buckets: list[int], post, parallel: int, gap: float, attempt: int) -> int:
        base = self.tables.version()
        waiting = self.tables.read("calls", buckets, version=base).filter((F.col("state") == "waiting") & (F.col("attempts") <= attempt))
        replies = materialize(_posted(waiting, post, parallel, gap), "outbox-replies")
        count = replies.count()
        if count:
            again = F.col("failure").isNotNull() | F.col("status").isin(*RETRYABLE)
            tried = waiting.select("call_key", "_id", "request", "attempts").join(replies.withColumnRenamed("_id", "call_key"), "call_key")
            done = tried.withColumn("attempts", F.col("attempts") + 1).withColumn(
                "state", F.when(again & (F.col("attempts") < self.attempts), F.lit("waiting")).when(again, F.lit("failed")).otherwise(F.lit("done"))
            )
            self.tables.commit({"calls": Change(done)}, base)
        return count


def _posted(calls: DataFrame, post: Callable[[str, str], dict], parallel: int, gap: float) -> DataFrame:
    names = REPLY_ROW.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Replies are committed by parts of buckets, so a row each on its own would gain nothing.
            replies = []
            for key, request in zip(batch["call_key"], batch["request"], strict=True):
                try:
                    reply = post(request, key)
                except Exception as error:
                    reply = {"failure": f"{type(error).__name__}: {error}"}
                replies.append({"_id": key, **reply})
                if len(replies) == REPLIES:
                    yield pd.DataFrame(replies, columns=names, dtype="object")
                    replies = []
                if gap:
                    time.sleep(gap)
            if replies:
                yield pd.DataFrame(replies, columns=names, dtype="object")

    return calls.select("call_key", "request").repartition(parallel, "call_key").mapInPandas(run, REPLY_ROW)
