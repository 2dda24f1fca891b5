"""The whole path on a small invented site: scan, retry, sizes, store, search, enrich, export, history, settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weblode.workbench import Workbench


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bench")
    flags = root / "flags"
    flags.mkdir()
    html = {
        "http://s.com": '<a href="/p1">1</a><a href="/files/a.txt">a</a><a href="/files/b.csv">b</a><a href="/slow">s</a>',
        "http://s.com/p1": '<a href="/other/A.txt">same name</a><a href="/files/c.pdf">c</a><a href="http://x.org/">x</a>',
        "http://s.com/slow": '<a href="/files/d.txt">d</a>',
    }

    def fetch(url):
        if url.endswith("/slow") and not (flags / "slow").exists():
            return {"failure": "timeout", "failure_text": ""}
        if url not in html:
            return {"status": 404}
        return {"status": 200, "content_type": "text/html", "body": html[url].encode()}

    def probe(url):
        if url.endswith("c.pdf") and not (flags / "c").exists():
            return {"status": 503}
        return {"status": 200, "content_length": "10"}

    def sizes(url):
        return {"status": 206, "content_range": "bytes 0-0/2048"} if url.endswith("txt") else {"status": 500}

    def download(url):
        return {"status": 200, "body": b"apple text " + url.encode()} if not url.endswith(".pdf") else {"status": 200, "body": b"%PDF"}

    made = Workbench(spark, str(root / "tables"), fetch, probe, sizes, download)
    made.update_settings(requests_per_second=10.0)
    made.flags = flags
    return made


def test_everything(bench, tmp_path):
    with pytest.raises(ValueError, match="Did you mean s.com"):
        bench.start_scan("s")
    with pytest.raises(ValueError, match="max_depth must be <= 10"):
        bench.start_scan("s.com", max_depth=11)
    scan = bench.start_scan("http://s.com", "common", "follow", 2)
    found = {r.url: r.is_accessible for r in bench.run_scan(scan).collect()}
    assert found == {"http://s.com/files/a.txt": True, "http://s.com/files/b.csv": True, "http://s.com/files/c.pdf": False}
    summary = bench.summary(scan)
    assert (summary["pages_scanned"], summary["documents_found"], summary["document_error_count"]) == (3, 3, 1)
    assert summary["has_retryable_errors"] and not summary["has_more_pages"]
    assert len(list(bench.progress(scan))) == 2

    (bench.flags / "slow").write_text("")
    (bench.flags / "c").write_text("")
    retried = bench.retry(scan)
    assert retried == {
        "docs_fixed": 1, "pages_fixed": 1, "new_docs_found": 1, "remaining_scan_errors": 0, "remaining_doc_errors": 0, "total_documents": 4,
    }
    with pytest.raises(ValueError, match="No errors"):
        bench.retry(scan)

    steps, totals = bench.calculate_sizes(scan, [r.url for r in bench.results(scan).collect()])
    assert steps.agg(F.max("completed"), F.max("total_bytes")).first()[:] == (4, 4096)
    assert totals.first().asDict() == {"total_bytes": 4096, "known_count": 2, "unknown_count": 2, "total_display": "4.0 KB"}

    stored = bench.store_documents(scan, bench.results(scan).select("url"))
    assert stored["files_completed"] == 4
    bench.store_documents(scan, ["http://s.com/files/a.txt"])
    assert bench.store().agg(F.count("*"), F.max("version")).first()[:] == (4, 1)
    assert [r.document_count for r in bench.stored_scans().collect()] == [4]
    assert [r.extension for r in bench.extensions().collect()] == [".csv", ".pdf", ".txt"]
    assert bench.search("apple", extension=".txt").count() == 2
    assert bench.status_counts() == {"pending": 4, "complete": 0, "failed": 0, "skipped": 0}

    def post(request):
        content = json.loads(request)["messages"][1]["content"]
        if "b.csv" in content:
            return {"status": 400, "body": "no"}
        return {"status": 200, "body": json.dumps({"output_text": json.dumps({"summary": "s", "title": "Zed"})})}

    counts = bench.enrich(post, "https://api.example", "m", pause=lambda s: None)
    assert counts == {"processed": 3, "succeeded": 2, "failed": 1, "skipped": 1}
    assert bench.status_counts("http://s.com") == {"pending": 0, "complete": 2, "failed": 2, "skipped": 0}
    assert [r.filename for r in bench.failed_details("http://s.com").collect()] == ["b.csv", "c.pdf"]
    assert bench.reset_summaries("http://s.com") == 2 and bench.reset_summaries("http://s.com") == 0
    assert bench.reset_summaries("http://s.com", failed_only=False) == 2

    place = tmp_path / "saved"
    place.mkdir()
    (place / "a.txt").write_text("there before")

    def stream(url):
        if url.endswith("b.csv"):
            raise ConnectionError("broken off")
        return [b"ab", b"c"]

    done, files = bench.download_to_folder(scan, bench.results(scan).select("url"), str(place), stream)
    assert done == {"total_files": 4, "files_completed": 3, "files_failed": 1, "bytes": 9}
    assert (place / "a_1.txt").read_text() == "abc" and (place / "a.txt").read_text() == "there before"
    assert [r.message for r in files.filter("NOT succeeded").collect()] == ["Connection error: broken off"]

    assert [(r.status, r.total_files, r.files_completed, r.files_failed) for r in bench.downloads().collect()] == [("complete", 4, 3, 1)]
    bench.cancel_download("second")
    none, listed = bench.download_to_folder(scan, ["http://s.com/files/a.txt"], str(place), stream, "second")
    assert none["files_completed"] == 0 and [r.message for r in listed.collect()] == ["Download cancelled"]
    assert {r.session_id: r.status for r in bench.downloads().collect()}["second"] == "cancelled"
    bench.compact(1)

    bench.export_csv("http://s.com", f"{tmp_path}/csv")
    one = bench.search("", extension=".pdf").first()
    assert bytes(bench.file(one._id).first().content) == b"%PDF"
    blobs = bench.blobs().count()
    assert bench.delete_document(one._id) and not bench.delete_document(one._id)
    assert bench.blobs().filter(F.startswith("gridfs_id", F.lit(one._id))).count() == 0
    assert bench.blobs().count() == blobs - 1
    assert bench.store().count() == 3

    assert bench.store_status()["document_count"] == 3
    assert bench.check_folder(str(place))["valid"] and bench.check_folder("")["code"] == "empty"
    assert bench.make_folder(str(place / "deeper")) == str(place / "deeper")
    with pytest.raises(ValueError):
        bench.make_folder("")

    row = bench.history().first()
    assert (row.scan_mode, row.pages_scanned, row.documents_found, row.total_size_bytes) == ("batch", 3, 3, 20)
    bench.clear_history()
    assert bench.history().count() == 0
    bench.close(scan)
    with pytest.raises(KeyError):
        bench.summary(scan)


def test_settings(bench):
    assert bench.update_settings(max_crawl_depth=99, ai_api_key="k")["ai_api_key"] == "********"
    assert bench.settings(masked=False)["ai_api_key"] == "k" and bench.settings()["max_crawl_depth"] == 10
    assert bench.reset_settings()["ai_api_key"] == ""
