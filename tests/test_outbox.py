"""Paid calls made once: keys, repeated tasks, lost drivers, one owner at a time."""

from __future__ import annotations

import pytest

from weblode.sources.outbox import Busy, Lease, Outbox


def service(folder):
    """A service that knows the calls it has answered by their key, kept in files as tasks are other processes."""
    place = str(folder)

    def post(request, key):
        import os
        import time

        os.makedirs(f"{place}/{key}", exist_ok=True)
        open(f"{place}/{key}/{time.time_ns()}", "w").close()
        if "bad" in request:
            return {"status": 400, "body": "no"}
        if "flaky" in request and len(os.listdir(f"{place}/{key}")) < 3:
            return {"status": 429}
        if "down" in request:
            raise ConnectionError("broken")
        return {"status": 200, "body": request.upper()}

    return post


def state(outbox):
    return {r._id: (r.state, r.attempts, r.status, r.body, r.failure) for r in outbox.calls().collect()}


def posts(folder):
    return {p.name: len(list(p.iterdir())) for p in folder.iterdir()}


def test_calls_are_made_until_answered(spark, tmp_path):
    outbox, seen = Outbox(spark, str(tmp_path / "box"), 4), tmp_path / "seen"
    rows = [("1", "one"), ("2", "bad"), ("3", "flaky"), ("4", "down"), ("1", "one")]
    requests = spark.createDataFrame(rows, "_id string, request string")
    outbox.put(requests)
    outbox.put(requests.limit(2))
    assert outbox.calls().count() == 4
    assert outbox.drain(service(seen), pause=lambda s: None) == 1 + 1 + 3 + 3
    assert state(outbox) == {
        "1": ("done", 1, 200, "ONE", None), "2": ("done", 1, 400, "no", None), "3": ("done", 3, 200, "FLAKY", None),
        "4": ("failed", 3, None, None, "ConnectionError: broken"),
    }
    assert sorted(posts(seen).values()) == [1, 1, 3, 3]
    # Nothing is left: no further call, also after the same requests came in again.
    outbox.put(requests)
    assert outbox.drain(service(seen), pause=lambda s: None) == 0 and sum(posts(seen).values()) == 8


def test_lost_driver_repeats_one_part_under_its_keys(spark, tmp_path, monkeypatch):
    outbox, seen = Outbox(spark, str(tmp_path / "box"), 4), tmp_path / "seen"
    outbox.put(spark.createDataFrame([(str(i), f"r{i}") for i in range(40)], "_id string, request string"))
    commit, commits = outbox.tables.commit, []

    def lost(changes, base=None):
        if len(commits) == 2:
            raise KeyboardInterrupt
        commits.append(1)
        return commit(changes, base)

    monkeypatch.setattr(outbox.tables, "commit", lost)
    with pytest.raises(KeyboardInterrupt):
        outbox.drain(service(seen), part=1)
    monkeypatch.undo()
    made = sum(posts(seen).values())
    kept = outbox.calls().filter("state = 'done'").count()
    assert 0 < kept < made < 40
    assert outbox.drain(service(seen), part=1) == 40 - kept
    # Repeated calls came under the keys they had: the service saw forty different ones.
    assert len(posts(seen)) == 40 and sum(posts(seen).values()) == 40 + made - kept
    assert {s[0] for s in state(outbox).values()} == {"done"}


def test_one_owner_at_a_time(spark, tmp_path):
    path = str(tmp_path / "lease")
    with Lease(spark, path, 60):
        with pytest.raises(Busy), Lease(spark, path, 60):
            pass
    with Lease(spark, path, -1), Lease(spark, path, 60):
        pass  # an expired one is taken over
    outbox = Outbox(spark, str(tmp_path / "box"))
    with Lease(spark, f"{outbox.root}/lease", 60), pytest.raises(Busy):
        outbox.drain(lambda request, key: {})
    assert outbox.drain(lambda request, key: {}) == 0


def test_replies_leave_a_task_together(spark, monkeypatch):
    import pandas as pd

    from weblode.sources import outbox as O

    taken = {}

    class Calls:
        def select(self, *names):
            return self

        repartition = select

        def mapInPandas(self, run, schema):
            taken["run"] = run

    O._posted(Calls(), lambda request, key: {"status": 200, "body": request}, 1, 0.0)
    calls = pd.DataFrame({"call_key": [str(i) for i in range(2_500)], "request": ["r"] * 2_500})
    assert [len(f) for f in taken["run"](iter([calls, calls[:3]]))] == [1_000, 1_000, 500, 3]
