"""Requests at no more than a given rate per host, over all tasks and runs.

Every request gets a time slot before anything is sent: its rank among its host's requests, counted from the host's next
free slot, which is kept as a table between runs.  A request is sent within ``slack`` of its slot or not at all; slots
are so far apart that no second sees more than the rate even if some are early and some late.  What missed its slot,
in a task that lagged or was repeated after a lost executor, is given a new one.

Ranks are counted in blocks, so a host with a third of all requests is no task of its own, and a host's requests are
dealt out by minutes of slots: each task has its own stretch of the host's time.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.url import domain_of
from weblode.operators.ordered import ordinals
from weblode.schemas import HOST_SLOTS
from weblode.session import materialize
from weblode.sinks.keyed import Change, KeyedTables, Layout
from weblode.sinks.tables import SnapshotConflict
from weblode.sources.http import BATCH_BYTES, RESPONSE

SLACK_MS = 200
#: Milliseconds of one host's slots that one task takes.
STRETCH_MS = 60_000

PACED = T.StructType([*RESPONSE.fields]).add("host", "string").add("slot_ms", "long").add("sent_ms", "long")


def spacing_ms(rate: float, slack_ms: int = SLACK_MS) -> int:
    """Milliseconds between slots: with sends up to the slack late, no window of a second holds more than ``rate``.

    Of a rate below one, no window of ``1 / rate`` seconds holds two.
    """
    if rate <= 0:
        raise ValueError("the rate must be positive")
    if rate >= 1:
        return math.ceil((1000 + slack_ms) / math.floor(rate))
    return math.ceil(1000 / rate + slack_ms)


def host_slots(urls: DataFrame, free: DataFrame, spacing: int, start_ms: int, order: str = "seq") -> DataFrame:
    """Add ``host`` and ``slot_ms`` to requests (``url`` and a unique ``order``).

    ``free`` (host, next_ms) holds the hosts' next free slots; others start at ``start_ms``, and nobody before it.
    """
    named = urls.withColumn("host", F.coalesce(domain_of(F.col("url")), F.lit("")))
    ranked = ordinals(named, order, "_rank", ["host"])
    known = free.select(F.col("host").alias("_host"), "next_ms")
    joined = ranked.join(known, F.col("host") == F.col("_host"), "left")
    first = F.greatest(F.coalesce("next_ms", F.lit(start_ms)), F.lit(start_ms))
    return joined.withColumn("slot_ms", (first + (F.col("_rank") - 1) * spacing).cast("bigint")).drop("_rank", "_host", "next_ms")


class HostPace:
    """The next free slot of every host met so far, kept below ``root``."""

    def __init__(self, spark: SparkSession, root: str, rate: float, slack_ms: int = SLACK_MS, buckets: int = 16):
        self.slack_ms, self.spacing = slack_ms, spacing_ms(rate, slack_ms)
        self.tables = KeyedTables(spark, root, {"hosts": Layout(HOST_SLOTS, "host")}, buckets)

    def schedule(self, urls: DataFrame, start_ms: int, order: str = "seq") -> DataFrame:
        """Requests with their slots, which are taken from then on; written, so that they stay what they are."""
        while True:
            base = self.tables.version()
            named = urls.select(F.coalesce(domain_of(F.col("url")), F.lit("")).alias("host")).distinct()
            free = self.tables.read("hosts", self.tables.buckets_of("hosts", named), version=base)
            slotted = materialize(host_slots(urls, free, self.spacing, start_ms, order), "host-slots")
            taken = slotted.groupBy("host").agg((F.max("slot_ms") + self.spacing).alias("next_ms"))
            try:
                self.tables.commit({"hosts": Change(taken)}, base)
                return slotted
            except SnapshotConflict:
                continue  # another run took slots of the same hosts: count again


def request_slotted(
    slotted: DataFrame,
    client: Callable[[str], dict],
    partitions: int,
    slack_ms: int = SLACK_MS,
    threads: int = 16,
    clock: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Send requests at their slots: a response row each, with ``sent_ms``, which is null if the slot was missed.

    A task goes through its requests in order of their slots, with up to ``threads`` in flight.  ``partitions`` should
    not exceed the tasks that run at once, or later ones miss their slots.
    """
    names = PACED.fieldNames()

    def send(url: str, host: str, slot: int) -> dict:
        now = round(clock() * 1000)
        if now > slot + slack_ms:
            return {"url": url, "host": host, "slot_ms": slot}
        return {"url": url, "host": host, "slot_ms": slot, "sent_ms": now, **client(url)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(threads) if threads > 1 else None
        flying: list[dict | Future] = []
        held: list[dict] = []
        size = 0
        for batch in batches:
            for url, host, slot in zip(batch["url"], batch["host"], batch["slot_ms"].astype(int), strict=True):
                wait = slot / 1000 - clock()
                if wait > 0:
                    sleep(wait)
                flying.append(pool.submit(send, url, host, slot) if pool else send(url, host, slot))
                # Finished ones leave from the front; a full queue waits for its oldest.
                while flying and (not isinstance(flying[0], Future) or flying[0].done() or len(flying) > 4 * threads):
                    held.append(_done(flying.pop(0)))
                    size += len(held[-1].get("body") or b"")
                if size >= batch_bytes:
                    yield pd.DataFrame(held, columns=names, dtype="object")
                    held, size = [], 0
        held += [_done(x) for x in flying]
        if pool:
            pool.shutdown()
        yield pd.DataFrame(held, columns=names, dtype="object")

    stretch = F.floor(F.col("slot_ms") / STRETCH_MS)
    dealt = slotted.select("url", "host", "slot_ms").repartition(partitions, "host", stretch)
    return dealt.sortWithinPartitions("slot_ms").mapInPandas(run, PACED)


def _done(answer: dict | Future) -> dict:
    return answer.result() if isinstance(answer, Future) else answer


def request_paced(
    urls: DataFrame, client: Callable[[str], dict], pace: HostPace, partitions: int, lead: float = 3.0, threads: int = 16
) -> DataFrame:
    """One response row per address, as :func:`http.request_all` gives them, each host at its pace.

    Requests that missed their slots are scheduled again until none is left.  ``lead`` seconds lie between counting
    slots and the first of them; if tasks take longer to start, so that slots are missed, the next round gives more.
    """
    spark = urls.sparkSession
    tasks = max(1, min(partitions, spark.sparkContext.defaultParallelism))
    left = materialize(urls.select("url").distinct().withColumn("seq", F.monotonically_increasing_id()), "paced-urls")
    answers = None
    while not left.isEmpty():
        slotted = pace.schedule(left, int((time.time() + lead) * 1000))
        sent = materialize(request_slotted(slotted, client, tasks, pace.slack_ms, threads), "paced-responses")
        done = sent.filter(F.col("sent_ms").isNotNull()).select(RESPONSE.fieldNames())
        answers = done if answers is None else answers.unionByName(done)
        missed = sent.filter(F.col("sent_ms").isNull()).select("url")
        lead *= 2
        left = materialize(left.join(missed, "url", "left_semi"), "paced-urls")
    return spark.createDataFrame([], RESPONSE) if answers is None else answers
