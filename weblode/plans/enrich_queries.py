"""Queries over extraction, summaries, replies and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.functions.errors import (
    api_error,
    connection_error_class,
    error_body,
    exhausted,
    is_retryable,
    retry_delay,
)
from weblode.functions.replies import parse_reply, provider_of, request_body, response_text
from weblode.functions.text import build_prompt, disposition_filename, text_parts
from weblode.operators import enrich as E
from weblode.operators import reports as R
from weblode.operators import store as S
from weblode.plans.fixtures import STORE_SQL, _sql_pick, docx_file, pick, recorded_range, recorded_reply, status_events, stored_documents, workbook_folder, xlsx_file
from weblode.plans.registry import query
from weblode.session import scratch_path
from weblode.sources.books import BookSource
from weblode.sources.files import extract_text, spreadsheet_profiles
from weblode.sources.http import failure_reasons, pages_from_responses, probed_documents, probed_sizes, request_all
from weblode.sources.outbox import Outbox
from weblode.sources.tables import spread, table
from weblode.streaming.keyed import current, watched_sessions
from weblode.streaming.progress import live_status, progress_counts, stream_table


def _with_store(sql: str) -> str:
    return f"WITH {STORE_SQL} {sql}"


# --- extraction -------------------------------------------------------------------------------

_FILE_KINDS = [".txt", "CSV", ".md", ".JSON", ".rtf", ".html", ".zip"]


@query(
    f"""WITH f AS (SELECT doc_id, text, {_sql_pick(_FILE_KINDS, 'doc_id')} AS extension, CASE WHEN doc_id % 29 = 0 THEN '' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS t FROM documents),
s AS (SELECT *, CASE WHEN extension IN ('.rtf', '.zip') THEN 'unsupported' WHEN t = '' THEN 'failed' ELSE 'complete' END AS text_extraction_status FROM f)
SELECT doc_id, text_extraction_status, CASE WHEN text_extraction_status = 'complete' THEN t ELSE '' END AS extracted_text FROM s"""
)
def extraction_status(spark, folder):
    padded = F.concat(F.lit(" \n\t"), F.when(F.col("doc_id") % 29 != 0, F.col("text")).otherwise(F.lit("")), F.lit(" \r\n"))
    files = table(spark, folder, "documents").select(
        "doc_id", padded.cast("binary").alias("content"), pick(_FILE_KINDS, F.col("doc_id")).alias("extension")
    )
    return extract_text(files).select("doc_id", "text_extraction_status", "extracted_text")


@query(
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), chr(10) || chr(10)) AS extracted_text, 'complete' AS text_extraction_status FROM documents"""
)
def docx_text(spark, folder):
    """Every document as a DOCX file, a paragraph per line, and its text read back."""
    files = table(spark, folder, "documents").select("doc_id", docx_file(F.col("text")).alias("content"), F.lit(".docx").alias("extension"))
    return extract_text(files).select("doc_id", F.col("extracted_text"), "text_extraction_status")


def _workbooks(spark, folder):
    key = F.col("c_custkey")
    customers = spread(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 2_000)
    return customers.select(
        key.alias("c_custkey"), xlsx_file(F.col("c_name"), key * 3, key % 20000 + 30000).alias("content"), F.lit(".xlsx").alias("extension")
    )


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, '[Sheet: S]' || chr(10) || 'Name | Number | Day' || chr(10) || c_name || ' | ' || (c_custkey * 3) || ' | ' ||
  strftime(DATE '1899-12-30' + CAST(c_custkey % 20000 + 30000 AS INT), '%Y-%m-%d') || ' 00:00:00' AS extracted_text FROM customer"""
)
def xlsx_text(spark, folder):
    """A workbook per customer with text, number and date cells, read back."""
    return extract_text(_workbooks(spark, folder)).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "extracted_text")


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, concat_ws(chr(10), 'Spreadsheet with 1 sheet(s): S', '', '--- Sheet: S (2 rows) ---', '  Column headers: Name | Number |  | Day',
  '  Sample data (1 of 1 data rows):', '    ' || c_name || ' | ' || (c_custkey * 3) || ' |  | ' || strftime(DATE '1899-12-30' + CAST(c_custkey % 20000 + 30000 AS INT), '%Y-%m-%d') || ' 00:00:00') AS profile FROM customer"""
)
def xlsx_profiles(spark, folder):
    """Profiles of the same workbooks."""
    found = spreadsheet_profiles(_workbooks(spark, folder), "c_custkey")
    return found.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "profile")


@query(
    """SELECT CAST(c_custkey // 200 AS BIGINT) AS book, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS sheet,
  row_number() OVER (PARTITION BY c_custkey // 200, c_custkey % 2 ORDER BY c_custkey) AS row, c_name || '||' || c_custkey AS line FROM customer"""
)
def xlsx_rows(spark, folder):
    """All customers written to workbooks and read back, a partition per sheet and row by row."""
    place = scratch_path(spark, "books")
    workbook_folder(table(spark, folder, "customer"), place).write.format("noop").mode("overwrite").save()
    spark.dataSource.register(BookSource)
    found = spark.read.format("xlsx").load(place)
    book = F.regexp_extract("path", r"book-(\d+)\.xlsx$", 1).cast("bigint")
    return found.select(book.alias("book"), "sheet", "row", F.array_join("cells", "|", "").alias("line"))


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END AS extension, doc_id % 37 <> 0 AS has_blob, CASE WHEN doc_id % 3 = 0 THEN text END AS st, CASE WHEN doc_id % 5 < 2 THEN text WHEN doc_id % 5 = 2 THEN '' END AS fa, CASE WHEN doc_id % 7 < 3 THEN text END AS oc FROM documents),
o AS (SELECT *, CASE WHEN NOT has_blob THEN 'failed' WHEN st IS NOT NULL THEN 'standard' WHEN extension = '.PDF' AND coalesce(fa, '') <> '' THEN 'fast' WHEN extension = '.PDF' AND coalesce(oc, '') <> '' THEN 'ocr' ELSE 'failed' END AS outcome FROM a)
SELECT count(*) AS total, count(*) FILTER (WHERE outcome <> 'failed') AS succeeded, count(*) FILTER (WHERE outcome = 'fast') AS fast, count(*) FILTER (WHERE outcome = 'ocr') AS ocr,
  count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE extension = '.PDF') AS pdf, count(*) FILTER (WHERE extension <> '.PDF') AS other FROM o"""
)
def reextraction_counts(spark, folder):
    return E.reextraction_counts(_attempts(spark, folder))


def _attempts(spark, folder):
    i = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.lpad(i.cast("string"), 12, "0").alias("_id"),
        F.when(i % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".txt")).alias("extension"),
        (i % 37 != 0).alias("has_blob"),
        F.when(i % 3 == 0, F.col("text")).alias("standard_text"),
        F.when(i % 5 < 2, F.col("text")).when(i % 5 == 2, F.lit("")).alias("fast_text"),
        F.when(i % 7 < 3, F.col("text")).alias("ocr_text"),
    )


@query(
    _with_store("""SELECT s._id, CASE WHEN f THEN 'complete' ELSE text_extraction_status END AS text_extraction_status, CASE WHEN f THEN 'pending' ELSE summary_status END AS summary_status,
  CASE WHEN f THEN NULL ELSE summary_error END AS summary_error, CASE WHEN f THEN trim(s2.text, ' ' || chr(9) || chr(10) || chr(13)) ELSE extracted_text END AS extracted_text FROM store s JOIN
  (SELECT doc_id, text, doc_id % 37 <> 0 AND (doc_id % 3 = 0 OR (doc_id % 2 = 0 AND (doc_id % 5 < 2 OR doc_id % 7 < 3))) AS f FROM documents) s2 ON s2.doc_id = s.seq""")
)
def reextraction_applied(spark, folder):
    store = E.apply_reextraction(stored_documents(spark, folder), _attempts(spark, folder))
    return store.select("_id", "text_extraction_status", "summary_status", "summary_error", "extracted_text")


# --- transitions ------------------------------------------------------------------------------


@query(
    _with_store("""SELECT _id, CASE WHEN summary_status = 'pending' AND (text_extraction_status IN ('failed', 'unsupported') OR extracted_text = '') THEN 'failed' ELSE summary_status END AS summary_status,
  CASE WHEN summary_status = 'pending' AND (text_extraction_status IN ('failed', 'unsupported') OR extracted_text = '') THEN 'Text extraction failed or unsupported file type' ELSE summary_error END AS summary_error FROM store""")
)
def marked_unsummarizable(spark, folder):
    return E.mark_unsummarizable().apply(stored_documents(spark, folder)).select("_id", "summary_status", "summary_error")


@query(
    _with_store("""SELECT _id, CASE WHEN re THEN 'pending' ELSE summary_status END AS summary_status, CASE WHEN re THEN NULL ELSE title END AS title, CASE WHEN re THEN 0 ELSE CASE WHEN keywords = '' THEN 0 ELSE 2 END END AS keywords,
  CASE WHEN re THEN NULL ELSE summary_model END AS summary_model FROM (SELECT *, scan_url = 'https://src3.example.com' AND summary_status IN ('complete', 'failed') AS re FROM store)""")
)
def scan_summaries_reset(spark, folder):
    store = E.reset_scan("https://src3.example.com").apply(stored_documents(spark, folder))
    return store.select("_id", "summary_status", "title", F.size("keywords").alias("keywords"), "summary_model")


@query(
    _with_store("""SELECT count(*) FILTER (WHERE summary_status = 'pending' AND (text_extraction_status IN ('failed', 'unsupported') OR extracted_text = '')) AS unsummarizable,
  count(*) FILTER (WHERE summary_status = 'failed') AS reset_failed, count(*) FILTER (WHERE summary_status = 'failed' AND scan_url = 'https://src3.example.com') AS reset_scan_failed,
  count(*) FILTER (WHERE summary_status IN ('failed', 'complete') AND scan_url = 'https://src3.example.com') AS reset_scan FROM store""")
)
def modified_counts(spark, folder):
    store = stored_documents(spark, folder)
    scan = "https://src3.example.com"
    return store.agg(
        E.mark_unsummarizable().modified(store).alias("unsummarizable"),
        E.reset_failed().modified(store).alias("reset_failed"),
        E.reset_failed(scan).modified(store).alias("reset_scan_failed"),
        E.reset_scan(scan).modified(store).alias("reset_scan"),
    )


_REPLIES = [
    '{"title": " A title ", "short_summary": "s", "summary": " text %s ", "keywords": ["a ", "", 3, null, "b"], "document_type": "memo"}',
    '```json\n{"summary": "fenced %s", "keywords": "none"}\n```',
    '{"summary": 12, "title": "%s"}',
    'not json %s',
    '{"title": "no summary %s"}',
    '["%s"]',
    '  {"summary": "plain %s", "title": null, "keywords": [0, false, "x"], "document_type": "other"}  ',
    '{"summary": "", "title": "%s"}',
]


def _replies(spark, folder):
    """A raw reply per conversation turn."""
    key = F.concat("conv_id", F.lit("-"), "turn")
    raw = F.replace(pick(_REPLIES, F.col("conv_id") + F.col("turn")), F.lit("%s"), key)
    return table(spark, folder, "conversations").select(key.alias("_id"), raw.alias("raw"))


_REPLY_SQL = f"""
r AS (SELECT conv_id || '-' || turn AS _id, replace({_sql_pick(_REPLIES, '(conv_id + turn)')}, '%s', conv_id || '-' || turn) AS raw, (conv_id + turn) % 8 AS k FROM conversations)"""


@query(
    f"""WITH {_REPLY_SQL}, j AS (SELECT *, CASE WHEN k = 1 THEN replace(replace(raw, '```json' || chr(10), ''), chr(10) || '```', '') ELSE raw END AS t FROM r),
v AS (SELECT *, CASE WHEN json_valid(t) THEN t END AS js FROM j),
g AS (SELECT *, coalesce(json_type(js, '$.summary') = 'VARCHAR' AND json_extract_string(js, '$.summary') <> '', false) AS ok FROM v)
SELECT _id, CASE WHEN ok THEN trim(coalesce(json_extract_string(js, '$.title'), '')) END AS title, CASE WHEN ok THEN trim(json_extract_string(js, '$.summary')) END AS summary,
  CASE WHEN ok THEN coalesce(json_extract_string(js, '$.document_type'), 'other') END AS document_type,
  CASE WHEN NOT ok THEN NULL WHEN coalesce(json_type(js, '$.keywords'), '') <> 'ARRAY' THEN '' ELSE array_to_string(list_transform(list_filter(json_extract_string(js, '$.keywords[*]'), lambda x: x IS NOT NULL AND x NOT IN ('', '0', 'false', 'null')), lambda x: trim(x)), '|') END AS keywords,
  CASE WHEN NOT ok THEN 'Failed to parse response as JSON: ' || raw END AS error FROM g"""
)
def ai_response_parse(spark, folder):
    rows = _replies(spark, folder).select("_id", parse_reply(F.col("raw")).alias("r"))
    return rows.select(
        "_id", "r.title", "r.summary", "r.document_type", F.array_join("r.keywords", "|").alias("keywords"), "r.error"
    )


@query(
    _with_store("""SELECT _id, CASE seq % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE summary_status END AS summary_status, CASE seq % 4 WHEN 0 THEN 'new ' || seq ELSE title END AS title,
  CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN 'bad ' || seq ELSE summary_error END AS summary_error, CASE seq % 4 WHEN 0 THEN 'm-1' ELSE summary_model END AS summary_model FROM store""")
)
def summaries_written(spark, folder):
    i = F.col("doc_id")
    good = i % 4 == 0
    text = i.cast("string")
    replies = table(spark, folder, "documents").filter((i % 4 == 0) | (i % 4 == 1)).select(
        F.lpad(text, 12, "0").alias("_id"),
        F.when(good, F.concat(F.lit("new "), text)).alias("title"),
        F.when(good, F.lit("s")).alias("short_summary"),
        F.when(good, F.lit("sum")).alias("summary"),
        F.when(good, F.array(F.lit("k"))).alias("keywords"),
        F.when(good, F.lit("memo")).alias("document_type"),
        F.when(~good, F.concat(F.lit("bad "), text)).alias("error"),
    )
    as_of = F.timestamp_seconds(F.lit(1720000000))
    store = E.write_summaries(stored_documents(spark, folder), replies, "m-1", as_of)
    return store.select("_id", "summary_status", "title", "summary_error", "summary_model")


@query(
    _with_store("""SELECT count(*) FILTER (WHERE extracted_text <> '') AS processed, count(*) FILTER (WHERE extracted_text <> '' AND summary_status <> 'failed') AS succeeded,
  count(*) FILTER (WHERE extracted_text <> '' AND summary_status = 'failed') AS failed, count(*) FILTER (WHERE extracted_text = '') AS skipped FROM store""")
)
def enrichment_counts(spark, folder):
    store = stored_documents(spark, folder)
    return E.enrichment_counts(store.select((F.col("extracted_text") != "").alias("attempted"), F.col("summary_error").alias("error")))


@query(
    """SELECT doc_id, 'Document filename: f' || doc_id || '.txt' || chr(10) || chr(10) || 'Document content:' || chr(10) || text AS prompt FROM documents"""
)
def prompt_truncation(spark, folder):
    """The whole text in one prompt: nothing is cut any more."""
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, folder, "documents").select("doc_id", build_prompt(name, F.col("text")).alias("prompt"))


@query(
    """WITH p AS (SELECT doc_id, text, unnest(range(1, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1) + 1)) AS part FROM documents)
SELECT doc_id, CAST(part AS INT) AS part, substr(text, (part - 1) * 1000 + 1, 1000) AS body FROM p"""
)
def prompt_parts(spark, folder):
    """Every character of every text in some part."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(text_parts(F.col("text"), 1000)).alias("at", "body"))
    return rows.select("doc_id", (F.col("at") + 1).alias("part"), "body")


@query(
    _with_store("""SELECT _id, CASE WHEN extension IN ('.xlsx', '.csv') AND seq % 2 = 0 THEN 'sheet' ELSE 'text' END AS kind,
  'Document filename: ' || filename || chr(10) || chr(10) || 'Document content' || CASE WHEN parts > 1 THEN ' (part ' || part || ' of ' || parts || ')' ELSE '' END || ':' || chr(10) || substr(body, (part - 1) * 12000 + 1, 12000) AS prompt
FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM (SELECT *, CAST(ceil(length(body) / 12000.0) AS BIGINT) AS parts FROM
  (SELECT *, CASE WHEN extension IN ('.xlsx', '.csv') AND seq % 2 = 0 THEN 'profile of ' || seq ELSE extracted_text END AS body FROM store))) WHERE summary_status = 'pending' AND text_extraction_status = 'complete' AND extracted_text <> ''""")
)
def summary_prompts(spark, folder):
    store = stored_documents(spark, folder)
    profiles = store.filter(F.col("seq") % 2 == 0).select("_id", F.concat(F.lit("profile of "), F.col("seq").cast("string")).alias("profile"))
    return E.prompts(E.take_pending(store), profiles).select("_id", "kind", "prompt")


# --- errors -----------------------------------------------------------------------------------

_ERRORS = [
    "API returned HTTP 429 | Retry-After: 30s | Response: x", "API returned HTTP 500 | Retry-After: 2s", "HTTP 404", "request timed out after 60",
    "Timed Out", "Connection failed: no route", "ServerDisconnectedError: bye", "API returned HTTP 401 | Response: HTTP", "API returned HTTP 503 | Retry-After: soons", "ok",
]


@query(
    f"""WITH e AS (SELECT event_id, {_sql_pick(_ERRORS, 'event_id')} || ' #' || user_id AS error FROM events),
r AS (SELECT *, try_cast(regexp_extract(error, 'Retry-After: ([^s]*)s', 1) AS INT) AS ra FROM e)
SELECT event_id, regexp_matches(error, 'HTTP (429|500|502|503|504)|timed out|Connection failed|ServerDisconnectedError') AS retryable, CAST(greatest(5, coalesce(ra, 0)) AS INT) AS first_delay,
  CAST(greatest(15, coalesce(ra, 0)) AS INT) AS second_delay, 'Failed after 3 attempts. Last error: ' || error AS final_error FROM r"""
)
def retry_classifier(spark, folder):
    error = F.concat(pick(_ERRORS, F.col("event_id")), F.lit(" #"), F.col("user_id").cast("string"))
    rows = table(spark, folder, "events").select("event_id", error.alias("error"))
    e = F.col("error")
    return rows.select(
        "event_id",
        is_retryable(e).alias("retryable"),
        retry_delay(e, 0).alias("first_delay"),
        retry_delay(e, 1).alias("second_delay"),
        exhausted(e).alias("final_error"),
    )


_CONNECTION = [
    "[Errno 111] Connection refused", "host: Name or service not known", "Authentication failed.", "server selection timed out",
    "SSL handshake failed", "author unknown", "weird", "connect timeout; certificate expired",
]


@query(
    f"""WITH e AS (SELECT event_id, lower({_sql_pick(_CONNECTION, 'event_id')} || props) AS t FROM events)
SELECT event_id, CASE WHEN regexp_matches(t, 'connection refused|errno 111') THEN 'refused' WHEN regexp_matches(t, 'no such host|nodename nor servname|name or service not known') THEN 'host' WHEN contains(t, 'auth') THEN 'auth'
  WHEN regexp_matches(t, 'timed out|timeout') THEN 'timeout' WHEN regexp_matches(t, 'ssl|tls|certificate') THEN 'tls' ELSE 'other' END AS error_class FROM e"""
)
def connection_errors(spark, folder):
    text = F.concat(pick(_CONNECTION, F.col("event_id")), "props")
    return table(spark, folder, "events").select("event_id", connection_error_class(text).alias("error_class"))


_BODIES = ['{"error": {"message": "m%s"}}', '{"message": "n%s", "detail": "d"}', '{"detail": "d%s"}', 'plain %s', '{"error": "text%s", "message": "q"}', '{"other": %s}']


@query(
    f"""WITH b AS (SELECT event_id, event_id % 6 AS k, replace({_sql_pick(_BODIES, 'event_id')}, '%s', CAST(user_id AS VARCHAR)) AS body, user_id FROM events),
m AS (SELECT *, CASE k WHEN 0 THEN 'm' || user_id WHEN 1 THEN 'n' || user_id WHEN 2 THEN 'd' || user_id ELSE body END AS message FROM b)
SELECT event_id, message AS error_body, 'API returned HTTP ' || (400 + event_id % 105) || CASE WHEN event_id % 2 = 0 THEN ' | Request-ID: r' || user_id ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' | Retry-After: 7s' ELSE '' END ||
  CASE WHEN event_id % 5 = 0 THEN ' | Rate-limit remaining: 0' ELSE '' END || ' | Response: ' || message AS error FROM m"""
)
def api_errors(spark, folder):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    body = F.replace(pick(_BODIES, e), F.lit("%s"), user)
    return table(spark, folder, "events").select(
        "event_id",
        error_body(body).alias("error_body"),
        api_error(
            e % 105 + 400, F.when(e % 2 == 0, F.concat(F.lit("r"), user)), F.when(e % 3 == 0, F.lit("7")),
            F.when(e % 5 == 0, F.lit("0")), body,
        ).alias("error"),
    )


@query(
    """WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS provider FROM conversations)
SELECT conv_id, turn, provider, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS answer, text AS sent_prompt FROM p"""
)
def provider_requests(spark, folder):
    url = F.when(F.col("turn") % 2 == 0, F.lit("https://api.Anthropic.example/v1")).otherwise(F.lit("https://x.example/v1"))
    provider = provider_of(url)
    text = F.when(F.col("turn") % 3 != 2, F.col("text"))
    messages_style = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content")))
    chat_style = F.when(
        F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    ).otherwise(F.to_json(F.struct(text.alias("output_text"))))
    body = F.when(provider == "anthropic", messages_style).otherwise(chat_style)
    request = request_body(provider, "m", F.lit("sys"), F.col("text"))
    sent = F.coalesce(F.get_json_object(request, "$.messages[1].content"), F.get_json_object(request, "$.messages[0].content"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", provider.alias("provider"), response_text(provider, body).alias("answer"), sent.alias("sent_prompt")
    )


# --- probes -----------------------------------------------------------------------------------

_TYPES = ["text/html; charset=utf-8", "application/xhtml+xml", "application/pdf", None]


def _responses(spark, folder):
    """A recorded response per event."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("https://h.example.com/d/"), F.lit("f"), e.cast("string"), F.lit(".pdf")).alias("url"),
        F.when(e % 7 != 6, F.element_at(F.array(F.lit(200), F.lit(206), F.lit(404), F.lit(200)), (e % 4).cast("int") + 1)).alias("status"),
        pick(_TYPES, e % 5).alias("content_type"),
        F.when(e % 3 == 0, e.cast("string")).when(e % 3 == 1, F.lit("abc")).alias("content_length"),
        F.when(e % 2 == 1, F.concat(F.lit("bytes 0-0/"), (e * 10).cast("string"))).alias("content_range"),
        F.when(e % 10 == 0, F.lit('attachment; filename="Named.PDF"')).when(e % 10 == 5, F.lit("inline; filename=")).alias("content_disposition"),
        F.col("props").cast("binary").alias("body"),
        F.when(e % 7 == 6, pick(["timeout", "connection", "other"], e)).alias("failure"),
        F.when(e % 7 == 6, F.lit("the remote end closed the line before a full answer arrived here")).alias("failure_text"),
    )


_RESPONSES_SQL = f"""
resp AS (SELECT event_id AS e, 'https://h.example.com/d/f' || event_id || '.pdf' AS url, CASE WHEN event_id % 7 <> 6 THEN CASE event_id % 4 WHEN 1 THEN 206 WHEN 2 THEN 404 ELSE 200 END END AS status,
  {_sql_pick(_TYPES, '(event_id % 5)')} AS content_type, props, CASE WHEN event_id % 7 = 6 THEN {_sql_pick(["timeout", "connection", "other"], 'event_id')} END AS failure,
  'the remote end closed the line before a full answer arrived here' AS failure_text FROM events)"""


@query(
    f"""WITH {_RESPONSES_SQL}, w AS (SELECT *, CASE failure WHEN 'timeout' THEN 'Request timed out' WHEN 'connection' THEN 'Connection error: ' || failure_text WHEN 'other' THEN 'Error: ' || failure_text ELSE
  CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN NOT regexp_matches(coalesce(content_type, ''), 'text/html|application/xhtml') THEN 'Not an HTML page' END END AS warning FROM resp)
SELECT url, CASE WHEN warning IS NULL THEN props END AS html, warning FROM w"""
)
def page_fetch_rules(spark, folder):
    return pages_from_responses(_responses(spark, folder))


@query(
    f"""WITH {_RESPONSES_SQL}, o AS (SELECT *, failure IS NULL AND status = 200 AS ok FROM resp)
SELECT url, CASE WHEN ok AND e % 10 = 0 THEN 'Named.PDF' ELSE 'f' || e || '.pdf' END AS filename, '.pdf' AS extension, CASE WHEN ok AND e % 3 = 0 THEN e END AS file_size_bytes, ok AS is_accessible,
  CASE WHEN ok THEN NULL WHEN failure = 'timeout' THEN 'Timeout' WHEN status IS NOT NULL THEN 'HTTP ' || status ELSE failure_text END AS error_message FROM o"""
)
def file_probes(spark, folder):
    responses = _responses(spark, folder)
    links = responses.select("url", F.lit("https://h.example.com/").alias("source_page"), F.lit(1).alias("depth"))
    probed = probed_documents(links, responses)
    return probed.select("url", "filename", "extension", "file_size_bytes", "is_accessible", "error_message")


@query(
    f"""WITH {_RESPONSES_SQL} SELECT url, CASE WHEN status = 206 THEN CASE WHEN e % 2 = 1 THEN e * 10 END WHEN status = 200 THEN CASE WHEN e % 3 = 0 THEN e END END AS size_bytes FROM resp"""
)
def ranged_sizes(spark, folder):
    return probed_sizes(_responses(spark, folder)).select("url", "size_bytes")


@query(
    """WITH u AS (SELECT DISTINCT url, length(url) AS n FROM pages)
SELECT url, CASE WHEN n % 5 = 0 THEN n * 100 WHEN n % 5 = 1 THEN n END AS size_bytes FROM u WHERE n % 5 <> 4"""
)
def bulk_sizes(spark, folder):
    """Every page's file size asked for with one-byte ranges; a request that raises is left out of the answer."""
    responses = request_all(table(spark, folder, "pages").select("url"), recorded_range, 8)
    return probed_sizes(responses.filter(F.col("failure").isNull() | (F.col("failure") != "other"))).select("url", "size_bytes")


@query(
    f"""WITH {_RESPONSES_SQL} SELECT url, CASE WHEN failure = 'timeout' THEN 'TIMEOUT' WHEN failure IS NOT NULL THEN 'ERROR: ' || failure_text ELSE 'HTTP ' || status END AS reason FROM resp WHERE failure IS NOT NULL OR status = 404"""
)
def probe_failures(spark, folder):
    return failure_reasons(_responses(spark, folder))


@query(
    """WITH h AS (SELECT event_id, event_id % 5 AS k, props FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'a b.pdf' WHEN 1 THEN 'x.doc; size=' || props WHEN 2 THEN NULL WHEN 3 THEN 'q.txt' ELSE 'one; ' END AS filename FROM h"""
)
def disposition_names(spark, folder):
    shapes = ['attachment; filename="a b.pdf"', "attachment; filename=x.doc; size=", "inline", "inline; filename='q.txt'", "filename=one; filename=two"]
    header = F.concat(pick(shapes, F.col("event_id")), F.when(F.col("event_id") % 5 == 1, F.col("props")).otherwise(F.lit("")))
    return table(spark, folder, "events").select("event_id", disposition_filename(header).alias("filename"))


@query(
    f"""WITH {STORE_SQL}, f AS (SELECT *, seq % 2 = 0 AS again FROM store)
SELECT seq, CASE WHEN NOT is_accessible AND again THEN 'again_' || seq ELSE filename END AS filename, is_accessible OR again AS is_accessible,
  CASE WHEN NOT is_accessible AND again THEN seq ELSE file_size_bytes END AS file_size_bytes, CASE WHEN NOT is_accessible AND NOT again THEN 'Timeout' END AS error_message FROM f"""
)
def retried_documents(spark, folder):
    from weblode.operators.crawl import retry_documents

    s = F.col("seq")
    key = F.concat("source_url", F.lit("#"), s.cast("string"))
    docs = stored_documents(spark, folder).select(
        "seq", key.alias("url"), "filename", "file_size_bytes", F.lit(None).cast("string").alias("file_size_display"),
        "is_accessible", F.when(~F.col("is_accessible"), F.lit("Timeout")).alias("error_message"),
    )
    probes = docs.select(
        "url", (s % 2 == 0).alias("is_accessible"), F.concat(F.lit("again_"), s.cast("string")).alias("filename"),
        s.alias("file_size_bytes"), F.lit("x").alias("file_size_display"),
    )
    return retry_documents(docs, probes).select("seq", "filename", "is_accessible", "file_size_bytes", "error_message")


@query(
    _with_store("""SELECT _id, CASE WHEN n % 7 = 0 THEN 'failed' ELSE 'done' END AS state, CAST(CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END AS INT) AS attempts,
  CAST(CASE WHEN n % 7 = 0 THEN 503 ELSE 200 END AS INT) AS status, CASE WHEN n % 7 <> 0 THEN 'summary of ' || n || ' characters' END AS body
FROM (SELECT _id, length('Summarize: ' || extracted_text) AS n FROM store WHERE summary_status = 'pending' AND text_extraction_status = 'complete' AND extracted_text <> '')""")
)
def summary_outbox(spark, folder):
    """A call for every pending summary, put in twice and drained twice: each is made until it is answered, and no more."""
    pending = E.take_pending(stored_documents(spark, folder)).select("_id", F.concat(F.lit("Summarize: "), "extracted_text").alias("request"))
    outbox = Outbox(spark, scratch_path(spark, "outbox"), buckets=8)
    for _ in range(2):
        outbox.put(pending)
        outbox.drain(recorded_reply, part=8, pause=lambda s: None)
    return outbox.calls().select("_id", "state", "attempts", "status", "body")


# --- status and streams -----------------------------------------------------------------------

_STATUS_SQL = """
WITH e AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'stored' WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'summarized' WHEN 'error' THEN 'failed' ELSE 'reset' END AS event FROM events),
l AS (SELECT doc_id, arg_max(event, seq) FILTER (WHERE event <> 'extracted') AS last_event, max(seq) FILTER (WHERE event <> 'extracted') AS last_at, max(seq) FILTER (WHERE event = 'extracted') AS ext_at, count(*) AS events FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN last_event = 'summarized' THEN 'complete' WHEN last_event = 'failed' AND NOT coalesce(ext_at > last_at, false) THEN 'failed' ELSE 'pending' END AS summary_status, events FROM l"""


@query(_STATUS_SQL)
def status_transitions(spark, folder):
    return E.status_from_events(status_events(table(spark, folder, "events")), "doc_id", "seq")


@query(_STATUS_SQL)
def status_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = stream_table(spark, folder, schema, pathGlobFilter="events.parquet")
    return current(live_status(status_events(stream)), ["doc_id"])


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
  CAST(coalesce(sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS total_bytes FROM events GROUP BY 1"""
)
def progress_stream_counts(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = stream_table(spark, folder, schema, pathGlobFilter="events.parquet").select(
        "user_id", (F.col("event_type") != "error").alias("succeeded"), F.floor(F.col("value") * 1000).cast("bigint").alias("size")
    )
    return current(progress_counts(stream, ["user_id"], size="size"), ["user_id"])


@query(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(min(ts)) // 1000 AS started_ms, epoch_us(max(ts)) // 1000 AS last_ms,
  count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
  CAST(coalesce(sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS total_bytes FROM events GROUP BY 1)
SELECT *, CASE WHEN last_ms + 6 * 3600000 < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000 THEN 'stale' ELSE 'active' END AS status FROM s"""
)
def session_timeouts(spark, folder):
    """Sessions by user: their counts, and whether six hours went by without an event of theirs."""
    schema = table(spark, folder, "events").schema
    outcomes = stream_table(spark, folder, schema, pathGlobFilter="events.parquet").select(
        F.col("user_id").alias("session"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("succeeded"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("size"),
    )
    found = current(watched_sessions(outcomes, "6 hours", "10 minutes"), ["session", "started"])
    times = [F.unix_millis(a).alias(b) for a, b in (("started", "started_ms"), ("last_heard", "last_ms"))]
    return found.select("session", *times, "completed", "failed", "total_bytes", "status")


@query(
    _with_store("SELECT _id, filename FROM store WHERE _id NOT IN (SELECT _id FROM store WHERE summary_status = 'failed')")
)
def documents_deleted(spark, folder):
    store = stored_documents(spark, folder)
    doomed = store.filter("summary_status = 'failed'").select("_id")
    return S.delete_matching(store, doomed).select("_id", "filename")


@query(
    _with_store("""SELECT scan_url, count(*) FILTER (WHERE summary_status = 'failed') AS failed, count(*) FILTER (WHERE summary_status = 'complete') AS complete FROM
  (SELECT scan_url, CASE WHEN summary_status = 'failed' THEN 'pending' ELSE summary_status END AS summary_status FROM store) GROUP BY 1""")
)
def failed_summaries_reset(spark, folder):
    store = E.reset_failed().apply(stored_documents(spark, folder))
    counts = R.status_counts(store, by_scan=True)
    return counts.groupBy("scan_url").agg(
        F.sum(F.when(F.col("summary_status") == "failed", F.col("documents")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("summary_status") == "complete", F.col("documents")).otherwise(0)).alias("complete"),
    )
