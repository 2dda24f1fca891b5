"""One pace per host over all tasks and runs."""

from __future__ import annotations

import collections
import time

import pytest
from pyspark.sql import functions as F

from weblode.plans.fixtures import RecordedClock
from weblode.sources.paced import HostPace, request_paced, request_slotted, spacing_ms


def urls_of(spark, counts):
    rows = [(i, f"http://{host}/{k}") for i, (host, k) in enumerate((h, k) for h, n in counts.items() for k in range(n))]
    return spark.createDataFrame(rows, "seq bigint, url string")


def busiest(times, window=1000):
    times = sorted(times)
    return max(sum(t <= x < t + window for x in times) for t in times)


@pytest.mark.parametrize("rate", [0.5, 1, 2, 2.5, 10])
def test_spacing_holds_the_rate_with_late_sends(rate):
    slots = [k * spacing_ms(rate) for k in range(40)]
    late = [s + (200 if k % 3 == 0 else 0) for k, s in enumerate(slots)]
    assert busiest(late, 1000 if rate >= 1 else int(1000 / rate)) <= max(1, rate)
    with pytest.raises(ValueError):
        spacing_ms(0)


def test_slots_go_on_over_runs_and_hosts(spark, tmp_path):
    pace = HostPace(spark, str(tmp_path), 4, buckets=4)
    first = pace.schedule(urls_of(spark, {"A.com": 500, "b.com": 3}), 1_000_000)
    second = HostPace(spark, str(tmp_path), 4, buckets=4).schedule(urls_of(spark, {"a.com": 5, "c.com": 2}), 1_000_000)
    slots = collections.defaultdict(list)
    for r in first.unionByName(second).collect():
        slots[r.host].append(r.slot_ms)
    assert {h: sorted(s) for h, s in slots.items()} == {
        h: [1_000_000 + 300 * k for k in range(n)] for h, n in {"a.com": 505, "b.com": 3, "c.com": 2}.items()
    }
    # Time that went by is not made up for.
    third = pace.schedule(urls_of(spark, {"b.com": 1}), 9_000_000)
    assert third.first().slot_ms == 9_000_000


def test_requests_of_a_large_host_are_dealt_by_time(spark, tmp_path):
    pace = HostPace(spark, str(tmp_path), 1, buckets=2)
    slotted = pace.schedule(urls_of(spark, {"big.com": 600, "x.com": 20}), 0)
    clock = RecordedClock(0.0)
    sent = request_slotted(slotted, lambda url: {"status": 200}, 6, threads=1, clock=clock, sleep=clock.sleep)
    tasks = sent.withColumn("task", F.spark_partition_id()).filter("host = 'big.com'").groupBy("task").count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 600
    times = [r.sent_ms for r in sent.filter("host = 'big.com'").collect()]
    assert None not in times and busiest(times) == 1


def test_a_missed_slot_is_not_used(spark, tmp_path):
    """A task that lags sends nothing late; what it missed is left for another slot."""
    slotted = HostPace(spark, str(tmp_path), 5).schedule(urls_of(spark, {"h.com": 20}), 0)
    clock = RecordedClock(0.0)

    def slow(url):
        clock.sleep(0.9)
        return {"status": 200}

    sent = request_slotted(slotted, slow, 1, threads=1, clock=clock, sleep=clock.sleep).collect()
    done = [r for r in sent if r.sent_ms is not None]
    assert 0 < len(done) < 20 and all(r.slot_ms <= r.sent_ms <= r.slot_ms + 200 and r.status == 200 for r in done)
    assert all(r.status is None for r in sent if r.sent_ms is None) and len(sent) == 20


def test_live_requests_keep_the_pace(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def client(url):
        (seen / f"{time.time_ns()}-{url.rpartition('/')[2]}").touch()
        time.sleep(0.05)
        return {"status": 200, "body": url.encode()}

    pace = HostPace(spark, str(tmp_path / "pace"), 10)
    urls = urls_of(spark, {"h.com": 25}).union(urls_of(spark, {"h.com": 1}))
    answers = request_paced(urls, client, pace, 4).collect()
    assert sorted(r.url for r in answers) == sorted({f"http://h.com/{k}" for k in range(25)})
    assert all(bytes(r.body).decode() == r.url for r in answers)
    times = [int(p.name.partition("-")[0]) / 1e6 for p in seen.iterdir()]
    assert len(times) == 25 and busiest(times) <= 10
    assert request_paced(urls.limit(0), client, pace, 4).count() == 0
