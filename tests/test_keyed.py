"""Tables that change in place: merge on read, single commits over tables, conflicts, compaction, pruned point reads."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.operators import store as S
from weblode.sinks import keyed
from weblode.sinks.keyed import Change, KeyedTables, Layout
from weblode.sinks.tables import SnapshotConflict

PAIR = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


@pytest.fixture()
def tables(spark, tmp_path):
    return KeyedTables(spark, str(tmp_path), {"a": Layout(PAIR, "k"), "b": Layout(PAIR, "k", "substr(k, 1, 1)", ("v",))}, buckets=8)


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), PAIR)


def held(table):
    return {r.k: r.v for r in table.collect()}


def folders(place, table):
    return sorted(p.relative_to(place / table).as_posix() for p in (place / table).glob("_change=*/_bucket=*"))


def test_changes_equal_a_dictionary(spark, tables):
    rng, want = random.Random(3), {"a": {}, "b": {}}
    for step in range(9):
        changes = {}
        for name in rng.sample(["a", "b"], rng.choice([1, 2])):
            new = {f"{rng.choice('xyz')}{rng.randrange(12)}": step * 100 + i for i in range(rng.randrange(1, 6))} | ({None: step} if step % 3 == 0 else {})
            gone = rng.sample(sorted(k for k in want[name] if k), min(2, len(want[name]) // 3))
            changes[name] = Change(frame(spark, new.items()), spark.createDataFrame([(g,) for g in gone], "k string"))
            want[name] = {k: v for k, v in {**want[name], **new}.items() if k not in gone}
        tables.commit(changes)
        if step in (3, 7):
            tables.compact("a", least=1 if step == 3 else 2)
        assert {name: held(tables.read(name)) for name in want} == want
    some = sorted(k for k in want["b"] if k)[:3]
    assert held(tables.read("b", keys=[*some, "nowhere"])) == {k: want["b"][k] for k in some}
    assert held(tables.read("b", keys=[])) == {}
    for name in want:
        tables.compact(name)
        assert held(tables.read(name)) == want[name]
        assert not any(s.changes for s in tables.state()[2][name].values())


def test_one_row_writes_one_bucket(spark, tables, tmp_path):
    tables.commit({"a": Change(frame(spark, [(f"k{i}", i) for i in range(200)]))})
    assert tables.compact("a") == list(range(8))
    before = folders(tmp_path, "a")
    tables.commit({"a": Change(frame(spark, [("k7", -7)]))})
    added = set(folders(tmp_path, "a")) - set(before)
    assert len(added) == 1
    bucket = int(added.pop().partition("_bucket=")[2])
    assert tables.compact("a") == [bucket]
    assert held(tables.read("a", keys=["k7", "k8"])) == {"k7": -7, "k8": 8}
    assert len(tables.read("a", keys=["k7"]).inputFiles()) == 1


def test_reading_unchanged_buckets_is_a_scan(spark, tables):
    tables.commit({"a": Change(frame(spark, [(f"k{i}", i) for i in range(50)]))})
    tables.compact("a")
    plan = tables.read("a")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_several_tables_change_at_once(spark, tables, tmp_path):
    """Nothing of a commit is seen before its entry, and unnamed folders are never read."""
    tables.commit({"a": Change(frame(spark, [("x", 1)])), "b": Change(frame(spark, [("x", 1)]))})
    (tmp_path / "_log" / "000000009").touch()
    tables._write("a", frame(spark, [("x", 5)]).withColumns({"_commit": F.lit(2).cast("bigint"), "_deleted": F.lit(False)}), 8)
    assert held(tables.read("a")) == held(tables.read("b")) == {"x": 1}
    assert tables.version() == 1 and held(tables.read("a", version=0)) == {}
    assert tables.vacuum(3600.0) == 0 and tables.vacuum(-5.0) == 1
    assert held(tables.read("a")) == {"x": 1}


def test_writers_of_one_bucket_conflict_others_do_not(spark, tables):
    tables.commit({"b": Change(frame(spark, [("x1", 1), ("y1", 1)]))})
    base = tables.version()
    tables.commit({"b": Change(frame(spark, [("x1", 2)]))}, base)
    with pytest.raises(SnapshotConflict):
        tables.commit({"b": Change(frame(spark, [("x2", 3)]))}, base)
    others = [c for c in "uvwyz" if tables.buckets_of("b", frame(spark, [(c, 0)])) != tables.buckets_of("b", frame(spark, [("x", 0)]))]
    assert tables.commit({"b": Change(frame(spark, [(f"{others[0]}9", 9)]))}, base) == base + 2
    assert held(tables.read("b")) == {"x1": 2, "y1": 1, f"{others[0]}9": 9}


def test_log_needs_no_long_replay(spark, tables, monkeypatch):
    monkeypatch.setattr(keyed, "FULL_ENTRY", 3)
    for i in range(7):
        tables.commit({"a": Change(frame(spark, [(f"k{i % 2}", i)]))})
    read = []
    entry = tables._entry
    monkeypatch.setattr(tables, "_entry", lambda n: read.append(n) or entry(n))
    assert held(tables.read("a")) == {"k0": 6, "k1": 5}
    assert read == [7, 6]


def test_nothing_to_commit(spark, tables):
    assert tables.commit({}) == 0 and held(tables.read("a")) == {}
    assert tables.commit({"a": Change(frame(spark, []))}) == 0 and tables.compact("a") == [] and tables.vacuum() == 0
    tables.commit({"a": Change(frame(spark, [("x", 1)]))})
    tables.commit({"a": Change(deleted=frame(spark, [("x", None), ("never", None)]))})
    assert len(tables.compact("a")) in (1, 2) and held(tables.read("a")) == {}
    assert held(tables.read("a", keys=["x"])) == {}


CAPTURE = "seq bigint, source_url string, scan_url string, filename string, extension string, source_page string, content string"


def captures(spark, data):
    rows = [(seq, f"http://s/{doc}", "http://s", f"{doc}.txt", ".txt", "http://s/p", content) for seq, doc, content in data]
    return spark.createDataFrame(rows, CAPTURE)


def test_keyed_upsert_equals_snapshot_upsert(spark, tmp_path):
    from weblode.schemas import STORED_DOCUMENT

    rng = random.Random(9)
    data = [(i, rng.choice("abcdefgh"), rng.choice("xy")) for i in range(40)]
    tables, plain = S.keyed_store(spark, str(tmp_path), 4), spark.createDataFrame([], STORED_DOCUMENT)
    for start in range(0, 40, 10):
        batch = captures(spark, data[start : start + 10])
        S.upsert_keyed(tables, batch)
        plain = S.upsert(plain, batch).cache()
        assert sorted(map(repr, tables.read("documents").collect())) == sorted(map(repr, plain.collect()))
    every = {(doc, content) for _, doc, content in data}
    assert tables.read("blobs").count() == len(every)
    one = plain.filter("filename = 'a.txt'").first()
    assert bytes(S.files_keyed(tables, [one._id]).first().content).decode() == data[max(i for i, d, _ in data if d == "a")][2]
    before = tables.version()
    assert S.delete_keyed(tables, [one._id, "nobody"]) == 1 and S.delete_keyed(tables, [one._id]) == 0
    assert tables.version() == before + 1
    assert tables.read("documents").count() == plain.count() - 1
    assert tables.read("blobs").count() == len({e for e in every if e[0] != "a"})


def test_one_capture_reads_and_writes_its_buckets_only(spark, tmp_path):
    tables = S.keyed_store(spark, str(tmp_path), 16)
    S.upsert_keyed(tables, captures(spark, [(i, f"doc{i}", f"text {i}") for i in range(64)]))
    for name in ("documents", "blobs"):
        tables.compact(name)
    before = {name: set(folders(tmp_path, name)) for name in ("documents", "blobs")}
    S.upsert_keyed(tables, captures(spark, [(99, "doc5", "new text")]))
    assert {name: len(set(folders(tmp_path, name)) - before[name]) for name in before} == {"documents": 1, "blobs": 1}
    row = tables.read("documents").filter("filename = 'doc5.txt'").first()
    assert (row.version, row.version_label) == (2, "v2")
    plan = tables.read("documents")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def scanned_rows(frame):
    """Rows that left the scan of a plan without exchanges, once it ran."""
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def test_point_read_uses_bloom_filters(spark, tmp_path):
    """A key that lies between a file's smallest and largest, but not in it, reads no row group."""
    tables = S.keyed_store(spark, str(tmp_path), 2)
    S.upsert_keyed(tables, captures(spark, [(i, f"doc{i}", f"text {i} " * 50) for i in range(300)]))
    tables.compact("blobs")
    one = tables.read("documents").filter("filename = 'doc7.txt'").first()
    assert S.files_keyed(tables, [one._id]).first().content == ("text 7 " * 50).encode()
    read = tables.read("blobs", keys=[one.gridfs_id])
    assert len(read.inputFiles()) == 1 and read.count() == 1 and scanned_rows(read) > 1
    wrong = one.gridfs_id[:-1] + ("0" if one.gridfs_id[-1] != "0" else "1")
    absent = tables.read("blobs", keys=[wrong])
    assert len(absent.inputFiles()) == 1 and scanned_rows(absent) == 0
    sizes = [p.stat().st_size for p in tmp_path.glob("blobs/_change=*/_bucket=*/*.parquet")]
    assert max(sizes) < 200_000
