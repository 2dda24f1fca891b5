"""Files, HTTP and service connectors with fake clients; downloads; streams; configuration."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from weblode.functions.requests import check_path
from weblode.operators.sheets import csv_profile, sheet_profile
from weblode.sinks import downloads as D
from weblode.sources import files as S
from weblode.sources import http as N
from weblode.sources import services as V
from weblode.sources.config import load_config
from weblode.sources.tables import health
from weblode.streaming.progress import live_status, progress_counts, run_available, stream_table, stream_to_table


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}{table}</w:body></w:document>'})


def xlsx(sheets):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>"
        + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        + "</Relationships>",
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>Name</t></si></sst>',
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f"<row>{''.join(rows_)}</row>" for rows_ in rows)
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>'
    return zipped(parts)


def cell(ref, value, kind=None):
    return f'<c r="{ref}"' + (f' t="{kind}"' if kind else "") + f"><v>{value}</v></c>"


BOOK = xlsx({
    "One": [[cell("A1", 0, "s"), cell("C1", "2.50")], [cell("A2", 7), cell("B2", 1, "b")], []],
    "Empty": [],
})


def test_extraction(spark):
    data = [
        (b"caf\xc3\xa9 ", ".txt"), (b"caf\xe9", "CSV"), (b"", ".txt"), (b"  \n", ".md"), (b"x", ".rtf"), (b"x", ""),
        (docx("one", " ", "two"), ".docx"), (b"broken", ".docx"), (BOOK, ".XLSX"), (b"%PDF", ".pdf"),
    ]
    frame = spark.createDataFrame([(i, bytearray(c), e) for i, (c, e) in enumerate(data)], "i int, content binary, extension string")
    got = [(r.extracted_text, r.text_extraction_status) for r in S.extract_text(frame).orderBy("i").collect()]
    assert got == [
        ("café", "complete"), ("café", "complete"), ("", "failed"), ("", "failed"), ("", "unsupported"), ("", "unsupported"),
        ("one\n\ntwo", "complete"), ("", "failed"), ("[Sheet: One]\nName | 2.5\n7 | True\n[Sheet: Empty]", "complete"), ("", "failed"),
    ]


def test_sheet_rows_and_profile(spark):
    frame = spark.createDataFrame([("f", bytearray(BOOK), ".xlsx")], "id string, content binary, extension string")
    profile = {r.sheet: r for r in sheet_profile(S.sheet_rows(frame, ["id"]), keys=["id"]).collect()}
    assert profile["One"].row_count == 2 and profile["One"].headers == "Name |  | 2.5"
    assert profile["Empty"].profile == "--- Sheet: Empty (0 rows) ---\n  (empty sheet)"
    assert profile["One"].profile.endswith("Sample data (1 of 1 data rows):\n    7 | True")


def test_spreadsheet_profiles(spark):
    data = [("x", bytearray(BOOK), ".xlsx"), ("c", bytearray(b"a,b\n1,2\n"), "CSV"), ("bad", bytearray(b"no"), ".xlsx")]
    frame = spark.createDataFrame(data, "id string, content binary, extension string")
    got = {r.id: r.profile for r in S.spreadsheet_profiles(frame, "id").collect()}
    assert got["c"] == "CSV file with approximately 2 rows\nColumn headers: a | b\nSample data (1 rows):\n  1 | 2"
    assert got["x"].startswith("Spreadsheet with 2 sheet(s): One, Empty\n\n--- Sheet: One (2 rows) ---\n")
    assert got["x"].endswith("\n\n--- Sheet: Empty (0 rows) ---\n  (empty sheet)") and "bad" not in got


def test_service_availability():
    assert V.is_available(lambda url: {"status": 200}, "http://x") and not V.is_available(lambda url: {"status": 200}, "")
    assert not V.is_available(lambda url: {"failure": "timeout"}, "http://x")


def test_csv_profile(spark):
    long = "a,b\n" + "".join(f"{i},x\n" for i in range(60))
    texts = [("1", long, ".csv"), ("2", 'h,"q,\n1"\n\n"v",w\n', "csv"), ("3", "a\tb\n1\t2", ".tsv"), ("4", " \n,\n", ".csv"), ("5", "", ".csv")]
    frame = spark.createDataFrame(texts, "id string, text string, extension string")
    got = {r.id: r for r in csv_profile(frame, ["id"]).collect()}
    assert got["1"].line_count == 61 and got["1"].samples == [f"{i} | x" for i in range(5)]
    assert got["1"].profile.endswith("... and approximately 55 more rows")
    assert got["2"].headers == "h | q,\n1" and got["2"].samples == ["v | w"]
    assert got["3"].headers == "a | b" and got["3"].profile.startswith("CSV file with approximately 1 rows")
    assert got["4"].profile == "" and got["5"].profile == ""


def test_read_files(spark, tmp_path):
    (tmp_path / "a b.TXT").write_bytes(b"x")
    (row,) = S.read_files(spark, str(tmp_path)).collect()
    assert (row.filename, row.extension, row.size) == ("a b.TXT", ".txt", 1)


def test_http(spark):
    def fake_client(url):
        if "slow" in url:
            return {"failure": "timeout", "failure_text": "t"}
        if "down" in url:
            return {"failure": "connection", "failure_text": "refused"}
        status = 404 if "gone" in url else 206 if "range" in url else 200
        kind = "application/pdf" if url.endswith(".pdf") else "text/html"
        return {"status": status, "content_type": kind, "content_length": "5", "content_range": "bytes 0-0/77", "body": b"<p>hi"}

    urls = spark.createDataFrame([(f"http://h/{n}",) for n in ("page", "slow", "down", "gone", "f.pdf", "range.pdf")], "url string")
    responses = N.request_all(urls, fake_client, 3).cache()
    pages = {r.url[9:]: (r.html, r.warning) for r in N.pages_from_responses(responses).collect()}
    assert pages == {
        "page": ("<p>hi", None), "slow": (None, "Request timed out"), "down": (None, "Connection error: refused"),
        "gone": (None, "HTTP 404"), "f.pdf": (None, "Not an HTML page"), "range.pdf": (None, "HTTP 206"),
    }
    sizes = {r.url[9:]: r.size_bytes for r in N.probed_sizes(responses).collect()}
    assert sizes == {"page": 5, "slow": None, "down": None, "gone": None, "f.pdf": 5, "range.pdf": 77}
    links = urls.select("url", F.lit("http://h/").alias("source_page"), F.lit(1).alias("depth"))
    documents = {r.url[9:]: (r.is_accessible, r.error_message, r.file_size_display) for r in N.probed_documents(links, responses).collect()}
    assert documents["f.pdf"] == (True, None, "5 B") and documents["slow"] == (False, "Timeout", None) and documents["gone"][1] == "HTTP 404"
    assert {r.url[9:]: r.reason for r in N.failure_reasons(responses).collect()} == {"slow": "TIMEOUT", "down": "ERROR: refused", "gone": "HTTP 404"}


def test_ranged_size_rules(spark):
    frame = spark.createDataFrame([(206, "bytes 0-0/x", "1"), (206, "nothing", "1"), (206, None, None), (200, None, " 9 "), (500, "a/5", "5")], "s int, r string, l string")
    assert [r[0] for r in frame.select(N.ranged_size(F.col("s"), F.col("r"), F.col("l"))).collect()] == [None, None, None, 9, None]


def test_reextraction_cascade(spark):
    data = [("1", ".txt", b"ok"), ("2", ".pdf", b"fast"), ("3", ".pdf", b"scan"), ("4", ".pdf", b"none"), ("5", ".pdf", None), ("6", ".rtf", b"x")]
    frame = spark.createDataFrame([(i, e, bytearray(c) if c is not None else None) for i, e, c in data], "_id string, extension string, content binary")
    ocr = V.ocr_text(lambda b: b * 100 if b == b"scan" else b"tiny", lambda b: f" read {len(b)} " if len(b) > 4 else None)
    attempts = V.reextract(frame, lambda b: "quick" if b == b"fast" else None, ocr).cache()
    got = {r._id: (r.standard_text, r.fast_text, r.ocr_text) for r in attempts.collect()}
    assert got == {
        "1": ("ok", None, None), "2": (None, "quick", None), "3": (None, None, "read 400"), "4": (None, None, None), "5": (None, None, None), "6": (None, None, None),
    }
    from weblode.operators.enrich import reextraction_counts

    assert tuple(reextraction_counts(attempts).select("total", "succeeded", "fast", "ocr", "failed").first()) == (6, 3, 1, 1, 3)
    assert V.first_of(lambda b: "", lambda b: "second")(b"") == "second" and V.first_of(lambda b: None)(b"") is None


def test_summaries_with_retries(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def post(request):
        text = json.loads(request)["messages"][-1]["content"]
        seen = len(list(log.glob(f"{text}-*")))
        (log / f"{text}-{seen}").write_text("")
        good = {"status": 200, "body": json.dumps({"choices": [{"message": {"content": json.dumps({"summary": f"about {text}"})}}]})}
        if text == "flaky" and seen == 0 or text == "busy":
            return {"status": 429, "retry_after": "30", "body": '{"message": "slow"}'}
        if text == "denied":
            return {"status": 401, "body": "no"}
        if text == "crash":
            raise ValueError("bad")
        return good if text != "odd" else {"status": 200, "body": "{}"}

    names = ["fine", "flaky", "busy", "denied", "crash", "odd"]
    prompts = spark.createDataFrame([(n, "text", n) for n in names], "_id string, kind string, prompt string")
    waits = []
    got = {r._id: (r.summary, r.error) for r in V.summarize(prompts, post, "https://x.example", "m", waits.append).collect()}
    assert got["fine"] == ("about fine", None) and got["flaky"] == ("about flaky", None)
    assert got["busy"][1].startswith("Failed after 3 attempts. Last error: API returned HTTP 429 | Retry-After: 30s")
    assert got["denied"][1] == "API returned HTTP 401 | Response: no" and got["crash"][1] == "ValueError: bad"
    assert got["odd"][1] == "API returned empty response content"
    assert waits == [30, 30]
    assert [len(list(log.glob(f"{n}-*"))) for n in names] == [1, 2, 3, 1, 1, 1]


def test_downloads(spark, tmp_path):
    def stream(url):
        if "slow" in url:
            raise TimeoutError
        yield b"ab"
        if "cut" in url:
            raise ConnectionError("reset")
        yield b"c"

    files = spark.createDataFrame([("ok", "ok.txt"), ("slow", "s.txt"), ("cut", "c.txt")], "url string, saved_name string")
    got = {r.url: (r.succeeded, r.message, r.bytes) for r in D.save_files(files, str(tmp_path), stream).collect()}
    assert got == {"ok": (True, "Downloaded successfully", 3), "slow": (False, "Download timed out", None), "cut": (False, "Connection error: reset", None)}
    assert os.listdir(tmp_path) == ["ok.txt"]


def test_cancelled_download(spark, tmp_path):
    """Stopped in the middle: what was finished is listed and stays, nothing is finished after."""
    stop = D.StopMarker(str(tmp_path / "stops" / "s1"))
    place = tmp_path / "place"
    place.mkdir()
    path = stop.path

    def stream(url):
        yield b"first"
        if url == "u3":
            os.makedirs(os.path.dirname(path), exist_ok=True)
            open(path, "w").close()
        yield b"second"

    files = spark.createDataFrame([(f"u{i}", f"f{i}") for i in range(8)], "url string, saved_name string").coalesce(1)
    got = [tuple(r) for r in D.save_files(files, str(place), stream, stop.seen).collect()]
    assert got == [(f"u{i}", f"f{i}", True, "Downloaded successfully", 11) if i < 3 else (f"u{i}", None, False, D.CANCELLED, None) for i in range(8)]
    assert sorted(os.listdir(place)) == ["f0", "f1", "f2"]


def test_download_targets(spark, tmp_path):
    (tmp_path / "file").write_text("x")

    def judge(path, required=0):
        seen = D.check_target(path, required)
        frame = spark.createDataFrame([tuple(seen.values())], "path string, exists boolean, is_dir boolean, writable boolean, free bigint, required bigint")
        c = F.col
        r = frame.select(check_path(c("exists"), c("is_dir"), c("writable"), c("path"), c("free"), c("required")).alias("r")).first().r
        return r.valid, r.code

    assert judge("") == (False, "empty") and judge("  ") == (False, "empty")
    assert judge(str(tmp_path)) == (True, None)
    assert judge(str(tmp_path / "file")) == (False, "not_directory")
    assert judge(str(tmp_path / "new" / "deep")) == (True, "not_exists")
    assert judge(str(tmp_path), 2**60) == (False, "insufficient_space")
    assert D.create_folder(str(tmp_path / "new" / "deep")) == (True, str(tmp_path / "new" / "deep"))


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("failed").alias("event"))
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    stream = stream_table(spark, path, events.schema, files_per_batch=1)
    assert {r.summary_status for r in stream_to_table(live_status(stream)).collect()} == {"failed"}
    counts = stream_to_table(progress_counts(stream.withColumn("succeeded", F.col("seq") % 2 == 0), []))
    assert tuple(counts.first()) == (events.filter("seq % 2 = 0").count(), events.filter("seq % 2 = 1").count())
    sizes, place = [], str(tmp_path / "checkpoint")
    run_available(stream, lambda batch, _: sizes.append(batch.count()), "append", place)
    run_available(stream, lambda batch, _: sizes.append(batch.count()), "append", place)
    assert len([s for s in sizes if s]) == 3 and sum(sizes) == events.count()


def test_config(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# note\nREQUEST_TIMEOUT=7\nAI_MODEL='m'\nUNKNOWN=1\n")
    config = load_config(str(env), {"REQUESTS_PER_SECOND": "0.5"})
    assert (config.request_timeout, config.ai_model, config.requests_per_second, config.max_crawl_depth) == (7, "m", 0.5, 10)


def test_health(spark):
    assert health(lambda: spark.range(3))["message"] == "Connected (3 documents stored)"

    def refuse():
        raise OSError("[Errno 111] Connection refused")

    assert health(refuse) == {"connected": False, "message": "Nothing answers at the store's address: it seems to be switched off.", "document_count": 0}


def test_long_texts_are_summarized_in_parts(spark):
    """Parts are summarized each, then their summaries together; a failing part fails its document."""
    from weblode.operators.enrich import prompts

    rows = [("1", "a.txt", ".txt", "x" * 25_000), ("2", "b.txt", ".txt", "short"), ("3", "c.txt", ".txt", "y" * 12_001 + "BAD")]
    pending = spark.createDataFrame(rows, "_id string, filename string, extension string, extracted_text string")

    def post(request):
        content = json.loads(request)["messages"][1]["content"]
        if "BAD" in content:
            return {"status": 400, "body": "no"}
        size = content.count("x")
        return {"status": 200, "body": json.dumps({"output_text": json.dumps({"summary": f"{size} of x" if size > 9 else content[-40:]})})}

    replies = {r._id: r for r in V.summarize_parts(prompts(pending), post, "https://api.example", "m", lambda s: None).collect()}
    assert replies["1"].summary.endswith("12001 of x\n\n12001 of x\n\n1001 of x")  # the file name has one too
    assert replies["2"].summary.endswith("short") and replies["2"].error is None
    assert replies["3"].summary is None and "HTTP 400" in replies["3"].error
    assert len(replies) == 3


def test_bodies_leave_by_size(spark):
    from weblode.sources import http

    urls = spark.createDataFrame([(f"http://h/{i}",) for i in range(40)], "url string")
    got = http.request_all(urls, lambda url: {"status": 200, "body": b"z" * 400}, 2, batch_bytes=1000)
    assert got.agg(F.count("*"), F.sum(F.length("body"))).first()[:] == (40, 16_000)


def test_workbook_dates():
    """Built-in and written-out date formats, a time, both calendars; literal letters make no date."""
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    formats = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/><numFmt numFmtId="172" formatCode="[Red]0.0"/></numFmts>'
    used = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 170, 171, 172, 21))
    styles = f'<styleSheet xmlns="{m}">{formats}<cellXfs>{used}</cellXfs></styleSheet>'
    cells = [f'<c r="{c}1" s="{k}"><v>{v}</v></c>' for c, k, v in (("A", 1, 45292), ("B", 2, "45292.75"), ("C", 3, 7), ("D", 4, "2.5"), ("E", 5, "0.5"), ("F", 1, 1))]
    book = {n: z for n, z in zip_parts(xlsx({"S": [cells]})).items()} | {"xl/styles.xml": styles}
    want = ["2024-01-01 00:00:00", "2024-01-01 18:00:00", "7", "2.5", "12:00:00", "1900-01-01 00:00:00"]
    assert S._xlsx_rows(zipped(book))[0][1] == [want]
    late = book | {"xl/workbook.xml": book["xl/workbook.xml"].replace("<sheets>", '<workbookPr date1904="1"/><sheets>')}
    assert S._xlsx_rows(zipped(late))[0][1][0][0] == "2028-01-02 00:00:00"


def zip_parts(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n).decode() for n in z.namelist()}
