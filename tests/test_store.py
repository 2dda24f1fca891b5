"""The document store: folding captures, transitions, search, export, history."""

from __future__ import annotations

import csv
import glob
import io
import random

import pytest
from pyspark.sql import functions as F

from weblode.operators import enrich as E
from weblode.operators import history as H
from weblode.operators import search as Q
from weblode.operators import store as S
from weblode.schemas import HISTORY, STORED_DOCUMENT
from weblode.sinks.exports import export_scan
from weblode.sinks.tables import SnapshotConflict, create_table, drop_snapshots, read_snapshot, snapshot_number, write_clustered, write_snapshot

CAPTURE = "seq bigint, source_url string, scan_url string, filename string, extension string, source_page string, content string"


def captures(spark, data):
    rows = [(seq, f"http://s/{doc}", "http://s", f"{doc}.txt", ".txt", "http://s/p", content) for seq, doc, content in data]
    return spark.createDataFrame(rows, CAPTURE)


def empty_store(spark):
    return spark.createDataFrame([], STORED_DOCUMENT)


def state(store):
    return {r.source_url[-1]: (r.version, r.version_label, r.content_hash, r.summary_status, r.title) for r in store.collect()}


def test_upsert_equals_one_by_one(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("abc"), rng.choice("xy")) for i in range(12)]
    batch = S.upsert(empty_store(spark), captures(spark, data))
    versions, last = {}, {}
    for _, doc, content in data:
        versions[doc] = versions.get(doc, 0) + (last.get(doc) != content)
        last[doc] = content
    assert {k: v[0] for k, v in state(batch).items()} == versions
    split = S.upsert(S.upsert(empty_store(spark), captures(spark, data[:5])), captures(spark, data[5:]))
    assert state(split) == state(batch)


def test_upsert_keeps_summary_of_unchanged_content(spark):
    store = S.upsert(empty_store(spark), captures(spark, [(1, "a", "x"), (2, "b", "x")]))
    done = store.withColumns({"summary_status": F.lit("complete"), "title": F.lit("T")})
    after = state(S.upsert(done, captures(spark, [(3, "a", "x"), (4, "b", "y")])))
    assert after["a"][0] == 1 and after["a"][3:] == ("complete", "T")
    assert after["b"][0] == 2 and after["b"][3:] == ("pending", None)
    # There and back again is two changes, and the summary is gone.
    again = state(S.upsert(done, captures(spark, [(3, "a", "y"), (4, "a", "x")])))
    assert again["a"][0] == 3 and again["a"][3] == "pending"


def test_upsert_without_stored_hash(spark):
    store = S.upsert(empty_store(spark), captures(spark, [(1, "a", "x")]))
    legacy = store.withColumns({"content_hash": F.lit(None).cast("string"), "version": F.lit(None).cast("int")})
    assert state(S.upsert(legacy, captures(spark, [(2, "a", "x")])))["a"][:2] == (1, "v1")
    assert [f.name for f in S.upsert(legacy, captures(spark, [(2, "a", "x")])).schema] == [f.name for f in STORED_DOCUMENT]


def test_blobs(spark):
    batch = captures(spark, [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "a", "y")])
    store = S.upsert(empty_store(spark), batch)
    blobs = S.new_blobs(batch, spark.createDataFrame([], "gridfs_id string"))
    assert blobs.count() == 3
    assert S.new_blobs(batch, blobs).count() == 0
    assert S.orphaned_blobs(store, blobs).count() == 1
    files = {r.filename: bytes(r.content) for r in S.get_files(store, blobs).collect()}
    assert files == {"a.txt": b"y", "b.txt": b"x"}
    ids = [r._id for r in store.filter("filename = 'a.txt'").collect()]
    kept, kept_blobs = S.delete_documents(store, blobs, ids)
    assert kept.count() == 1 and kept_blobs.count() == 2
    assert S.get_documents(store, ids).count() == 1


def summaries(spark):
    rows = [
        ("1", "pending", "complete", "text", None), ("2", "pending", "failed", "", None), ("3", "pending", "complete", " \n", None),
        ("4", "complete", "complete", "text", None), ("5", "failed", "complete", "text", "e"), ("6", "pending", "pending", "text", None),
        ("7", "failed", "unsupported", None, "e"),
    ]
    base = spark.createDataFrame(rows, "_id string, summary_status string, text_extraction_status string, extracted_text string, summary_error string")
    extra = [f for f in STORED_DOCUMENT if f.name not in base.columns]
    return base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in extra}).withColumn("scan_url", F.lit("s"))


def test_status_filters(spark):
    store = summaries(spark)

    def ids(condition):
        return sorted(r._id for r in store.filter(condition).collect())

    assert ids(E.pending_summary()) == ["1", "3"]
    assert ids(E.unsummarizable()) == ["2"]
    assert ids(E.reextract_candidate()) == ["2", "7"]
    assert ids(E.failed_summary("s")) == ["5", "7"] and ids(E.failed_summary("t")) == []


def test_transitions(spark):
    store = summaries(spark)
    after = {r._id: r for r in E.mark_blank().apply(E.mark_unsummarizable().apply(store)).collect()}
    assert after["2"].summary_error.startswith("Text extraction failed") and after["3"].summary_error == "No extracted text available"
    reset = {r._id: (r.summary_status, r.summary_error) for r in E.reset_failed().apply(store).collect()}
    assert reset["5"] == ("pending", None) and reset["4"] == ("complete", None)
    assert store.agg(E.reset_scan("s").modified(store)).first()[0] == 3
    replies = spark.createDataFrame(
        [("1", "T", "s", "sum", ["k"], "memo", None), ("6", None, None, None, None, None, "boom")],
        "_id string, title string, short_summary string, summary string, keywords array<string>, document_type string, error string",
    )
    written = {r._id: r for r in E.write_summaries(store, replies, "m", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (written["1"].summary_status, written["1"].title, written["1"].summary_model) == ("complete", "T", "m")
    assert (written["6"].summary_status, written["6"].summary_error) == ("failed", "boom")
    assert written["4"].summary_status == "complete" and len(written) == 7


def test_status_fold_equals_loop(spark):
    rng = random.Random(9)
    kinds = ["stored", "extracted", "summarized", "failed", "reset"]
    data = [(rng.randint(0, 6), i, rng.choice(kinds)) for i in range(120)]
    got = {r.doc: r.summary_status for r in E.status_from_events(spark.createDataFrame(data, "doc int, seq bigint, event string"), "doc", "seq").collect()}
    want = {}
    for doc, _, event in data:
        before = want.get(doc, "pending")
        if event == "extracted":
            want[doc] = "pending" if before == "failed" else before
        else:
            want[doc] = {"summarized": "complete", "failed": "failed"}.get(event, "pending")
    assert got == want


def test_search(spark):
    store = summaries(spark).withColumns({
        "filename": F.concat(F.lit("f"), "_id"), "extension": F.lit(".txt"),
        "extracted_text": F.when(F.col("_id") == "1", "Red apple red").when(F.col("_id") == "2", "green apple pie").otherwise("none"),
    })
    hits = [(r._id, r.score) for r in Q.search(store, "RED apple").collect()]
    assert hits == [("1", 3), ("2", 1)]
    assert [r._id for r in Q.search(store, "apple -red").collect()] == ["2"]
    assert [r._id for r in Q.search(store, '"apple pie"').collect()] == ["2"]
    assert [(r._id, r.score) for r in Q.search_index(Q.build_index(store), "red apple").collect()] == hits
    assert Q.search(store, extension=".pdf").count() == 0
    assert "extracted_text" not in Q.search(store, "apple").columns
    with pytest.raises(ValueError):
        Q.search(store, limit=0)


@pytest.mark.parametrize("phrase", ["of the", "the", "of the end", ". the", "a-b", "f the e", "(the)"])
def test_phrases_in_the_index_are_those_of_the_scan(spark, phrase):
    texts = ["proof there red", "red of the end", "red. The, of", "of red the", "proof therefore of the ender red", "a-b red (the)", "aa-bb", "of the end"]
    store = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "_id string, extracted_text string")
    query = f'red "{phrase}"'
    want = [(r._id, r.score) for r in Q.search(store, query).collect()]
    assert [(r._id, r.score) for r in Q.search_index(Q.build_index(store), query, 50, store).collect()] == want


def test_csv_export_bytes(spark, tmp_path):
    store = S.upsert(empty_store(spark), captures(spark, [(1, "b", "x"), (2, "a", "y"), (3, "c", "z")]))
    store = store.withColumn("title", F.when(F.col("filename") == "c.txt", F.lit('A "quoted", title')))
    export_scan(store, "http://s", f"{tmp_path}/out")
    (part,) = glob.glob(f"{tmp_path}/out/part-*.csv")
    data = open(part, newline="").read()
    rows = list(csv.reader(io.StringIO(data, newline="")))
    assert rows[0] == ["Document Title", "Short Summary", "Document URL", "Filename", "Document Type", "Version"]
    assert [r[3] for r in rows[1:]] == ["c.txt", "a.txt", "b.txt"]
    assert rows[1][0] == 'A "quoted", title' and rows[2][0] == "<automated title extraction failed>"
    assert data.count("\r\n") == 4


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/table"
    assert read_snapshot(spark, root, STORED_DOCUMENT).count() == 0
    write_snapshot(spark.range(3).toDF("x"), root)
    write_snapshot(read_snapshot(spark, root).filter("x > 0"), root, by=["x"])
    (tmp_path / "table" / "data-unfinished").mkdir()
    (tmp_path / "table" / "_log" / "000000009").touch()
    assert sorted(r.x for r in read_snapshot(spark, root).collect()) == [1, 2]
    base = snapshot_number(spark, root)
    write_snapshot(spark.range(5).toDF("x"), root, base=base)
    with pytest.raises(SnapshotConflict):
        write_snapshot(spark.range(7).toDF("x"), root, base=base)
    assert read_snapshot(spark, root).count() == 5
    assert drop_snapshots(spark, root, keep=1) == 2 and read_snapshot(spark, root).count() == 5
    write_clustered(spark.range(100).toDF("x"), f"{tmp_path}/clustered", ["x"], 4)
    assert spark.read.parquet(f"{tmp_path}/clustered").count() == 100


def test_create_table(spark, tmp_path):
    create_table(spark, "history_test", HISTORY, f"{tmp_path}/history")
    create_table(spark, "history_test", HISTORY, f"{tmp_path}/history")
    assert spark.table("history_test").columns == [f.name for f in HISTORY]
    spark.sql("DROP TABLE history_test")


def test_history(spark):
    scans = spark.createDataFrame([(i, f"http://u{i}") for i in range(8)], "id bigint, url string")
    kept = H.append(spark.createDataFrame([], HISTORY), scans, 5)
    assert [r.id for r in kept.collect()] == [7, 6, 5, 4, 3]
    assert [r.id for r in H.newest(kept, 2).collect()] == [7, 6]
    assert H.newest(kept, -1).count() == 5
    assert sorted(r.id for r in H.pruned_away(scans, 5).collect()) == [0, 1, 2]
