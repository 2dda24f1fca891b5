"""Tables the queries run on, derived from the given ones.

The given tables hold pages, texts and events but no stored documents, scans or probes.  Each
function here derives one such table for *every* row of its source; ``SQL`` holds the same
derivations as common table expressions for the checking engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.text import mime_type, type_label
from weblode.sources.tables import table

EXTENSIONS = [".pdf", ".docx", ".xlsx", ".txt", ".csv"]


def pick(values: list, index: Column) -> Column:
    """``values[index mod n]``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def _sql_pick(values: list, index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_sql_literal(v)}" for i, v in enumerate(values))
    return f"CASE {index} % {len(values)} {cases} END"


def _sql_literal(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


SUMMARY_ERRORS = [
    "API returned HTTP 429 | Retry-After: 30s | Response: slow down",
    "API call timed out after 60 seconds",
    "Failed to parse response as JSON: oops",
    "API returned HTTP 401 | Response: bad key",
]


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document store: one record per document, status from its label."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    i = F.col("doc_id")
    status = (
        F.when(F.col("quality") == 1, F.lit("complete"))
        .when(F.col("toxic") == 1, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    base = documents.join(labels, "doc_id", "left").select(
        i.alias("seq"),
        "text",
        "lang",
        "n_chars",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("scan_url"),
        pick(EXTENSIONS, i).alias("extension"),
        status.alias("summary_status"),
    )
    named = base.withColumn("filename", F.concat(F.lit("file_"), (F.col("seq") % 60).cast("string"), F.col("extension")))
    s = F.col("seq")
    done = F.col("summary_status") == "complete"
    return named.select(
        "seq",
        F.lpad(s.cast("string"), 12, "0").alias("_id"),
        "filename",
        "extension",
        type_label(F.col("extension")).alias("file_type_label"),
        F.concat("scan_url", F.lit("/docs/"), "filename").alias("source_url"),
        F.concat("scan_url", F.lit("/p/"), (s % 13).cast("string")).alias("source_page"),
        "scan_url",
        F.when(s % 11 != 0, F.col("n_chars")).alias("file_size_bytes"),
        mime_type(F.col("extension")).alias("content_type"),
        F.concat(F.lit("blob-"), s.cast("string")).alias("gridfs_id"),
        F.timestamp_seconds(F.lit(1700000000) + s * 60).alias("downloaded_at"),
        F.when(s % 31 != 0, F.col("text")).otherwise(F.lit("")).alias("extracted_text"),
        F.when(s % 17 == 0, F.lit("unsupported"))
        .when(s % 19 == 0, F.lit("failed"))
        .otherwise(F.lit("complete"))
        .alias("text_extraction_status"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(1).alias("version"),
        F.lit("v1").alias("version_label"),
        F.when(done, F.substring("text", 1, 40)).alias("title"),
        F.when(done, F.substring("text", 41, 80)).alias("short_summary"),
        F.when(done, F.substring("text", 121, 200)).alias("summary"),
        F.when(done, F.array("lang", F.concat(F.lit("kw"), (s % 7).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("keywords"),
        F.when(done, F.lit("report")).alias("document_type"),
        "summary_status",
        F.when(F.col("summary_status") == "failed", pick(SUMMARY_ERRORS, s)).alias("summary_error"),
        F.when(done, F.timestamp_seconds(F.lit(1710000000) + s)).alias("summarized_at"),
        F.when(done, F.lit("model-a")).alias("summary_model"),
        (s % 23 != 0).alias("is_accessible"),
    )


def _sql_case(table_: dict[str, str], key: str, default: str) -> str:
    whens = " ".join(f"WHEN {_sql_literal(k)} THEN {_sql_literal(v)}" for k, v in table_.items())
    return f"CASE {key} {whens} ELSE {default} END"


def _store_sql() -> str:
    from weblode.lookups import MIME_TYPES, TYPE_LABELS

    few = {k: v for k, v in TYPE_LABELS.items() if k in EXTENSIONS}
    return f"""
base AS (
  SELECT d.doc_id AS seq, d.text, d.lang, d.n_chars, 'https://' || d.source || '.example.com' AS scan_url,
    {_sql_pick(EXTENSIONS, 'd.doc_id')} AS extension,
    CASE WHEN l.quality = 1 THEN 'complete' WHEN l.toxic = 1 THEN 'failed' ELSE 'pending' END AS summary_status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
named AS (SELECT *, 'file_' || (seq % 60) || extension AS filename FROM base),
store AS (
  SELECT seq, lpad(CAST(seq AS VARCHAR), 12, '0') AS _id, filename, extension,
    {_sql_case(few, 'extension', "'?'")} AS file_type_label,
    scan_url || '/docs/' || filename AS source_url, scan_url || '/p/' || (seq % 13) AS source_page, scan_url,
    CASE WHEN seq % 11 <> 0 THEN n_chars END AS file_size_bytes,
    {_sql_case(MIME_TYPES, 'extension', "'application/octet-stream'")} AS content_type,
    'blob-' || seq AS gridfs_id, make_timestamp((1700000000 + CAST(seq AS BIGINT) * 60) * CAST(1000000 AS BIGINT)) AS downloaded_at,
    CASE WHEN seq % 31 <> 0 THEN text ELSE '' END AS extracted_text,
    CASE WHEN seq % 17 = 0 THEN 'unsupported' WHEN seq % 19 = 0 THEN 'failed' ELSE 'complete' END AS text_extraction_status,
    sha256(text) AS content_hash, 1 AS version, 'v1' AS version_label,
    CASE WHEN summary_status = 'complete' THEN substr(text, 1, 40) END AS title,
    CASE WHEN summary_status = 'complete' THEN substr(text, 41, 80) END AS short_summary,
    CASE WHEN summary_status = 'complete' THEN substr(text, 121, 200) END AS summary,
    CASE WHEN summary_status = 'complete' THEN lang || ' kw' || (seq % 7) ELSE '' END AS keywords,
    CASE WHEN summary_status = 'complete' THEN 'report' END AS document_type,
    summary_status,
    CASE WHEN summary_status = 'failed' THEN {_sql_pick(SUMMARY_ERRORS, 'seq')} END AS summary_error,
    CASE WHEN summary_status = 'complete' THEN 'model-a' END AS summary_model,
    seq % 23 <> 0 AS is_accessible
  FROM named)"""


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures over time: few documents captured often, content is the language tag, which repeats."""
    store = stored_documents(spark, folder)
    lang = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("content"))
    return store.select(
        "seq", "source_url", "scan_url", "filename", "extension", "source_page", "downloaded_at"
    ).join(lang, "seq")


def link_graph(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst``: every page points to pages ``3 id + 1`` and ``3 id + 2`` modulo their number."""
    pages = table(spark, folder, "pages").select("page_id")
    n = pages.agg(F.count("*")).scalar()
    return pages.select(
        F.col("page_id").alias("src"),
        F.explode(F.array((F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 3 + 2) % n)).alias("dst"),
    )


GRAPH_SQL = """
n AS (SELECT count(*) AS n FROM pages),
link_graph AS (SELECT page_id AS src, (page_id * 3 + b) % n AS dst FROM pages, n, (VALUES (1), (2)) v(b))"""


def cross_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the given pages: ``url, position, link``, three per page, the last repeating the first."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    n = pages.agg(F.count("*")).scalar()
    targets = pages.select(
        F.col("page_id").alias("_id"), F.col("url").alias("link")
    )
    steps = pages.select(
        "url",
        F.posexplode(
            F.array(
                (F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 3 + 2) % n, (F.col("page_id") * 3 + 1) % n,
                F.col("page_id"),
            )
        ).alias("position", "_id"),
    )
    return steps.join(targets, "_id").select("url", "position", "link")


def site_markup(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages as one site: page ``k`` lives at ``/p/k`` and also links to two other pages and one file.

    ``urls, html``: links carry the spelling they were found under, so each page answers to both of its spellings.
    """
    pages = table(spark, folder, "pages").select("page_id", "html")
    n = pages.agg(F.count("*")).scalar()
    k = F.col("page_id")
    more = F.concat(
        F.lit('<a href="/p/'), ((k * 3 + 1) % n).cast("string"), F.lit('?utm_source=x">a</a><a href="/p/'),
        ((k * 3 + 2) % n).cast("string"), F.lit('/">b</a><a href="/files/r_'), (k % 40).cast("string"),
        F.lit('.pdf?v='), k.cast("string"), F.lit('">c</a>'),
    )
    both = F.array(
        F.concat(F.lit("https://site.example.com/p/"), k.cast("string"), F.lit("?utm_source=x")),
        F.concat(F.lit("https://site.example.com/p/"), k.cast("string"), F.lit("/")),
    )
    return pages.select(both.alias("urls"), F.concat("html", more).alias("html"))


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`site_markup` with a row per address: ``url, html``."""
    return site_markup(spark, folder).select(F.explode("urls").alias("url"), "html")


def sized_events(spark: SparkSession, folder: str) -> DataFrame:
    """Probed sizes in order: ``seq, url, size_bytes``; error events have none."""
    events = table(spark, folder, "events").select("event_id", "event_type", "value", "user_id")
    size = F.floor(F.col("value") * 1000).cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("https://files.example.com/u"), F.col("user_id").cast("string"), F.lit("/report-"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("url"),
        F.when(F.col("event_type") != "error", size).alias("size_bytes"),
    )


SIZED_SQL = """
sized AS (
  SELECT event_id AS seq, 'https://files.example.com/u' || user_id || '/report-' || event_id || '.pdf' AS url,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value * 1000) AS BIGINT) END AS size_bytes
  FROM events)"""

STATUS_EVENTS = {
    "view": "stored", "click": "extracted", "purchase": "summarized", "error": "failed", "signup": "reset",
}


def status_events(source: DataFrame) -> DataFrame:
    """``doc_id, seq, event`` from the event table (or a stream of it)."""
    from weblode.lookups import lookup

    return source.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        lookup(STATUS_EVENTS, F.col("event_type")).alias("event"),
    )


def history_proxy(spark: SparkSession, folder: str) -> DataFrame:
    """Scan history from orders."""
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("id"),
        F.concat(F.lit("https://www.shop-"), (k % 37).cast("string"), F.lit(".example.com/catalogue/section/"), k.cast("string")).alias("url"),
        pick(["single", "follow", "follow"], k).alias("crawl_option"),
        (k % 5 + 1).cast("int").alias("max_depth"),
        pick(["single page", "batch", "continuous"], k).alias("scan_mode"),
        pick(["common", "all", "pdf_only", "custom"], k).alias("document_filter"),
        (k % 500).alias("pages_scanned"),
        F.when(k % 6 != 0, k % 90).alias("documents_found"),
        F.when(k % 4 != 0, k % 3).alias("scan_error_count"),
        (k % 2).alias("document_error_count"),
        F.when(k % 9 != 0, F.floor(F.col("o_totalprice")) % 9000 / F.lit(2.0)).alias("duration_seconds"),
        F.when(k % 8 != 0, F.floor(F.col("o_totalprice")).cast("bigint") * (k % 1000)).alias("total_size_bytes"),
        F.col("o_orderdate").alias("completed_at"),
    )


HISTORY_SQL = f"""
history AS (
  SELECT o_orderkey AS id,
    'https://www.shop-' || (o_orderkey % 37) || '.example.com/catalogue/section/' || o_orderkey AS url,
    {_sql_pick(["single", "follow", "follow"], 'o_orderkey')} AS crawl_option,
    CAST(o_orderkey % 5 + 1 AS INT) AS max_depth,
    {_sql_pick(["single page", "batch", "continuous"], 'o_orderkey')} AS scan_mode,
    {_sql_pick(["common", "all", "pdf_only", "custom"], 'o_orderkey')} AS document_filter,
    o_orderkey % 500 AS pages_scanned,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 90 END AS documents_found,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS scan_error_count,
    o_orderkey % 2 AS document_error_count,
    CASE WHEN o_orderkey % 9 <> 0 THEN (CAST(floor(o_totalprice) AS BIGINT) % 9000) / 2.0 END AS duration_seconds,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) END AS total_size_bytes,
    o_orderdate AS completed_at
  FROM orders)"""

STORE_SQL = _store_sql()

CAPTURES_SQL = STORE_SQL + """,
captures AS (
  SELECT s.seq, s.source_url, s.scan_url, s.filename, s.extension, s.source_page, d.lang AS content,
    sha256(d.lang) AS content_hash
  FROM store s JOIN documents d ON d.doc_id = s.seq)"""


# --- office files made from rows --------------------------------------------------------------


def _zipped(parts: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            package.writestr(name, text)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def docx_file(text: pd.Series) -> pd.Series:
    """A text document with one paragraph per line."""
    from xml.sax.saxutils import escape

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def made(value: str) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in value.split("\n"))
        return _zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})

    return text.map(made)


@F.pandas_udf(T.BinaryType())
def xlsx_file(name: pd.Series, number: pd.Series, day: pd.Series) -> pd.Series:
    """A workbook of one sheet: a row of headings, then a name, a number, a gap and a date cell."""
    from xml.sax.saxutils import escape

    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = "http://schemas.openxmlformats.org/package/2006/relationships"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs>'

    def made(values) -> bytes:
        title, count, serial = values
        heads = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{h}</t></is></c>' for c, h in zip("ABD", ("Name", "Number", "Day")))
        cells = f'<c r="A2" t="inlineStr"><is><t>{escape(title)}</t></is></c><c r="B2"><v>{count}</v></c><c r="D2" s="1"><v>{serial}</v></c>'
        return _zipped({
            "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{p}"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{m}">{styles}</styleSheet>',
            "xl/worksheets/s.xml": f'<worksheet xmlns="{m}"><sheetData><row>{heads}</row><row>{cells}</row></sheetData></worksheet>',
        })

    return pd.Series([made(v) for v in zip(name, number, day)])


def workbook_folder(customers: DataFrame, folder: str) -> DataFrame:
    """A workbook per 200 customer keys below a shared folder, even and odd keys on a sheet each; one row per book."""

    def write(batches):
        import os
        from xml.sax.saxutils import escape

        m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        p = "http://schemas.openxmlformats.org/package/2006/relationships"
        place = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(place, exist_ok=True)
        for batch in batches:
            for book, people in zip(batch["book"], batch["people"], strict=True):
                parts = {
                    "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="even" sheetId="1" r:id="a"/><sheet name="odd" sheetId="2" r:id="b"/></sheets></workbook>',
                    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{p}"><Relationship Id="a" Target="worksheets/s0.xml"/><Relationship Id="b" Target="worksheets/s1.xml"/></Relationships>',
                    "xl/sharedStrings.xml": f'<sst xmlns="{m}">' + "".join(f"<si><t>{escape(x['name'])}</t></si>" for x in people) + "</sst>",
                }
                for k in (0, 1):
                    rows = "".join(
                        f'<row><c r="A1" t="s"><v>{i}</v></c><c r="C1"><v>{x["key"]}</v></c></row>' for i, x in enumerate(people) if x["key"] % 2 == k
                    )
                    parts[f"xl/worksheets/s{k}.xml"] = f'<worksheet xmlns="{m}"><sheetData>{rows}</sheetData></worksheet>'
                path = f"{place}/book-{book}.xlsx"
                with open(f"{path}.part", "wb") as out:
                    out.write(_zipped(parts))
                os.replace(f"{path}.part", path)
            yield batch[["book"]]

    key = F.col("c_custkey").cast("bigint")
    people = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("c_name").alias("name"))))
    books = customers.groupBy(F.floor(key / 200).cast("bigint").alias("book")).agg(people.alias("people"))
    return books.mapInPandas(write, "book bigint")


class RecordedClock:
    """A clock that stands still but for the waiting done on it."""

    def __init__(self, now: float):
        self.now = now

    def __call__(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds


def recorded_response(url: str) -> dict:
    """What a page's address was answered with: every fifth one is gone."""
    return {"status": 404 if int(url.rpartition("#")[2]) % 5 == 0 else 200, "content_type": "text/html"}


def recorded_reply(request: str, key: str) -> dict:
    """What a summary service answered: it was overloaded by every seventh length."""
    if len(request) % 7 == 0:
        return {"status": 503}
    return {"status": 200, "body": f"summary of {len(request)} characters"}


def recorded_range(url: str) -> dict:
    """What a one-byte range request was answered with, by the address's length."""
    n = len(url)
    return (
        {"status": 206, "content_range": f"bytes 0-0/{n * 100}"},
        {"status": 200, "content_length": f" {n} "},
        {"status": 404},
        {"failure": "timeout", "failure_text": ""},
        {"failure": "other", "failure_text": "raised"},
    )[n % 5]
