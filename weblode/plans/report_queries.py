"""Queries over history, progress, settings, downloads and their display forms."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weblode.functions.requests import check_path
from weblode.functions.sizes import (
    duration_seconds,
    eta_seconds,
    format_duration,
    format_eta,
    rate_delay,
    relative_day,
)
from weblode.functions.text import escape_html, sanitize_filename, truncate
from weblode.lookups import MASKED_KEY, SETTING_BOUNDS, SETTING_DEFAULTS
from weblode.operators import history as H
from weblode.operators import progress as P
from weblode.operators import reports as R
from weblode.operators import settings as G
from weblode.operators.naming import collision_names, unique_names
from weblode.operators.sheets import csv_profile, sheet_profile, sheet_text, workbook_profile
from weblode.plans.fixtures import (
    HISTORY_SQL,
    SIZED_SQL,
    STORE_SQL,
    _sql_pick,
    history_proxy,
    pick,
    sized_events,
    stored_documents,
)
from weblode.plans.link_queries import _sql_size
from weblode.plans.registry import query
from weblode.sources.tables import table

# --- history ----------------------------------------------------------------------------------


@query(f"WITH {HISTORY_SQL} SELECT id, url, scan_mode, total_size_bytes FROM history ORDER BY id DESC LIMIT 20")
def history_top_n(spark, folder):
    return H.newest(history_proxy(spark, folder), 20).select("id", "url", "scan_mode", "total_size_bytes")


@query(
    f"""WITH {HISTORY_SQL} SELECT scan_mode, CAST(count(*) AS BIGINT) AS removed FROM history
WHERE id NOT IN (SELECT id FROM history ORDER BY id DESC LIMIT 20) GROUP BY 1"""
)
def history_pruned(spark, folder):
    gone = H.pruned_away(history_proxy(spark, folder), 20)
    return gone.groupBy("scan_mode").agg(F.count("*").alias("removed"))


def _sql_clock(x: str, drop: bool) -> str:
    def near(v):
        return f"CAST(floor({v} + 0.5) AS BIGINT)"

    rest = near(f"fmod({x}, 60)")
    whole = f"CAST(floor({x} / 60) AS BIGINT) || 'm'"
    minute = f"CASE WHEN {rest} = 0 THEN {whole} ELSE {whole} || ' ' || {rest} || 's' END" if drop else f"{whole} || ' ' || {rest} || 's'"
    return (
        f"CASE WHEN {x} < 60 THEN {near(x)} || 's' WHEN {x} < 3600 THEN {minute} "
        f"ELSE CAST(floor({x} / 3600) AS BIGINT) || 'h ' || {near(f'fmod({x}, 3600) / 60')} || 'm' END"
    )


@query(
    f"""WITH {HISTORY_SQL}, h AS (SELECT *, regexp_extract(url, '^https://(.*)$', 1) AS host_path, CAST(duration_seconds AS DOUBLE) AS secs FROM history)
SELECT id, CASE WHEN length(host_path) > 40 THEN substr(host_path, 1, 37) || '...' ELSE host_path END AS url,
  CASE scan_mode WHEN 'single page' THEN 'Single' WHEN 'batch' THEN 'Batch' ELSE 'Continuous' END AS mode,
  CASE document_filter WHEN 'common' THEN 'Common Documents' WHEN 'all' THEN 'All Files' WHEN 'pdf_only' THEN 'PDFs Only' ELSE document_filter END AS filter,
  CASE WHEN crawl_option = 'single' THEN '-' ELSE CAST(max_depth AS VARCHAR) END AS depth, pages_scanned AS pages, coalesce(documents_found, 0) AS documents,
  CASE WHEN secs IS NULL THEN '-' ELSE {_sql_clock('secs', True)} END AS duration,
  coalesce(scan_error_count, 0) + coalesce(document_error_count, 0) AS errors,
  CASE WHEN coalesce(total_size_bytes, 0) = 0 THEN '-' ELSE {_sql_size('total_size_bytes', True)} END AS size,
  CASE date_diff('day', CAST(completed_at AS DATE), DATE '2001-08-01') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(completed_at, '%b %-d') END || ' ' || strftime(completed_at, '%H:%M') AS date
FROM h"""
)
def history_view(spark, folder):
    as_of = F.lit("2001-08-01 12:00:00").cast("timestamp_ntz")
    return R.history_view(history_proxy(spark, folder), as_of)


@query(
    f"""WITH {STORE_SQL}, scans AS (SELECT scan_url, row_number() OVER (ORDER BY scan_url) AS id, count(*) AS pages FROM store GROUP BY 1),
docs AS (SELECT s.id, t.* FROM store t JOIN scans s ON s.scan_url = t.scan_url)
SELECT c.scan_url AS url, CASE WHEN length(c.scan_url) % 2 = 0 THEN 'single page' WHEN contains(c.scan_url, '1') THEN 'continuous' ELSE 'batch' END AS scan_mode,
  CAST(count(*) AS BIGINT) AS documents_found, CAST(count(*) FILTER (WHERE NOT is_accessible) AS BIGINT) AS document_error_count,
  CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes, CAST(length(c.scan_url) * 10 AS DOUBLE) AS duration_seconds,
  max(file_size_bytes) AS largest_file_size
FROM docs d JOIN scans c ON c.id = d.id GROUP BY c.scan_url"""
)
def history_rows(spark, folder):
    store = stored_documents(spark, folder)
    n = F.length("scan_url")
    scans = store.groupBy("scan_url").agg(F.count("*").alias("pages_scanned")).select(
        F.xxhash64("scan_url").alias("id"),
        F.col("scan_url").alias("url"),
        F.when(n % 2 == 0, F.lit("single")).otherwise(F.lit("follow")).alias("crawl_option"),
        F.lit(2).alias("max_depth"),
        F.contains("scan_url", F.lit("1")).alias("scan_all_pages"),
        F.lit("common").alias("document_filter"),
        "pages_scanned",
        F.lit(0).cast("bigint").alias("scan_error_count"),
        F.lit(100.0).alias("start_time"),
        (F.lit(100.0) + n * 10).alias("end_time"),
    )
    documents = store.select(F.xxhash64("scan_url").alias("id"), "seq", "filename", "file_size_bytes", "is_accessible")
    rows = H.history_rows(scans, documents)
    return rows.select(
        "url", "scan_mode", "documents_found", "document_error_count", "total_size_bytes", "duration_seconds", "largest_file_size"
    )


@query(
    f"""WITH {STORE_SQL}, r AS (SELECT scan_url, count(*) AS n, count(*) FILTER (WHERE NOT is_accessible) AS bad FROM store WHERE NOT contains(scan_url, '7') GROUP BY 1),
q AS (SELECT DISTINCT scan_url FROM store)
SELECT q.scan_url AS url, coalesce(n, 0) AS documents_found, CAST(coalesce(n % 7, 0) AS BIGINT) AS pages_remaining, coalesce(n % 7, 0) > 0 AS has_more_pages,
  coalesce(bad, 0) AS document_error_count, coalesce(bad, 0) + coalesce(n % 2, 0) > 0 AS has_retryable_errors, CASE WHEN n IS NOT NULL THEN 12.5 END AS duration_seconds
FROM q LEFT JOIN r ON r.scan_url = q.scan_url"""
)
def scan_summary(spark, folder):
    store = stored_documents(spark, folder)
    finished = ~F.contains("scan_url", F.lit("7"))
    requests = store.select("scan_url").distinct().select(
        F.col("scan_url").alias("session_id"), F.col("scan_url").alias("url"), F.lit("follow").alias("crawl_option"),
        F.lit(3).alias("max_depth"), F.lit("common").alias("document_type_filter"), F.lit(False).alias("scan_all_pages"),
        F.lit(100.0).alias("start_time"), F.when(finished, F.lit(112.5)).alias("end_time"),
    )
    results = store.filter(finished).groupBy(F.col("scan_url").alias("session_id")).agg(
        F.count("*").alias("documents_found"), F.count_if(~F.col("is_accessible")).alias("document_error_count"),
        (F.count("*") % 7).alias("pages_remaining"), (F.count("*") % 2).alias("failed_pages"),
        F.lit(0).cast("bigint").alias("scan_error_count"), F.count("*").alias("pages_scanned"),
    )
    return R.scan_summary(requests, results).select(
        "url", "documents_found", "pages_remaining", "has_more_pages", "document_error_count", "has_retryable_errors",
        "duration_seconds",
    )


# --- progress ---------------------------------------------------------------------------------


@query(
    f"""WITH {SIZED_SQL}, r AS (SELECT *, sum(size_bytes) OVER w AS t, count(size_bytes) OVER w AS k, count(*) OVER w AS c, count(*) OVER () AS n FROM sized WINDOW w AS (ORDER BY seq))
SELECT seq, c AS completed, n AS total, k AS known_count, CAST(coalesce(t, 0) AS BIGINT) AS total_bytes, {_sql_size('CAST(coalesce(t, 0) AS BIGINT)', False)} AS total_display FROM r"""
)
def size_progress(spark, folder):
    return P.size_progress(sized_events(spark, folder)).drop("url", "size_bytes")


@query(
    f"""WITH {SIZED_SQL} SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, count(size_bytes) AS known_count,
  count(*) - count(size_bytes) AS unknown_count, {_sql_size('CAST(coalesce(sum(size_bytes), 0) AS BIGINT)', False)} AS total_display FROM sized"""
)
def size_totals(spark, folder):
    return R.size_totals(sized_events(spark, folder))


@query(
    f"""WITH {SIZED_SQL}, r AS (SELECT *, count(*) OVER w AS i, count(size_bytes) OVER w AS ok, count(*) OVER () AS n FROM sized WINDOW w AS (ORDER BY seq))
SELECT seq, i AS current_file_index, n AS total_files, ok - (CASE WHEN size_bytes IS NULL THEN 0 ELSE 1 END) AS files_completed,
  i - ok - (CASE WHEN size_bytes IS NULL THEN 1 ELSE 0 END) AS files_failed, 'Downloading f' || seq || '...' AS message FROM r"""
)
def download_progress(spark, folder):
    files = sized_events(spark, folder).select(
        "seq", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("filename"), F.col("size_bytes").isNotNull().alias("succeeded")
    )
    return P.download_progress(files).drop("filename", "succeeded")


@query(
    f"""WITH {SIZED_SQL} SELECT count(*) AS total_files, count(size_bytes) AS files_completed, count(*) - count(size_bytes) AS files_failed,
  'Downloaded ' || count(size_bytes) || ' files, ' || (count(*) - count(size_bytes)) || ' failed' AS message FROM sized"""
)
def download_summary(spark, folder):
    return P.download_summary(sized_events(spark, folder).withColumn("succeeded", F.col("size_bytes").isNotNull()))


@query(
    f"""WITH {STORE_SQL} SELECT seq, CAST(sum(CASE WHEN extension = '.pdf' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  - (CASE WHEN extension = '.pdf' THEN 1 ELSE 0 END) AS BIGINT) AS remaining FROM store"""
)
def remaining_work(spark, folder):
    rows = stored_documents(spark, folder).select("seq", "extension")
    return P.remaining_after(rows, F.lower("extension") == ".pdf").select("seq", "remaining")


@query(f"WITH {SIZED_SQL} SELECT seq, row_number() OVER (ORDER BY seq) AS ordinal, count(*) OVER () AS total FROM sized")
def numbered_rows(spark, folder):
    return P.numbered(sized_events(spark, folder).select("seq"))


@query(
    f"""WITH {SIZED_SQL}, r AS (SELECT *, sum(size_bytes) OVER w AS t, count(size_bytes) OVER w AS k, count(*) OVER w AS c, count(*) OVER () AS n FROM sized WINDOW w AS (ORDER BY seq))
SELECT 'progress' AS event, '{{"completed":' || c || ',"total":' || n || ',"current_url":"' || CASE WHEN length(url) > 50 THEN substr(url, 1, 50) || '...' ELSE url END ||
  '","known_count":' || k || ',"total_bytes":' || CAST(coalesce(t, 0) AS BIGINT) || ',"total_display":"' || {_sql_size('CAST(coalesce(t, 0) AS BIGINT)', False)} || '"}}' AS data FROM r"""
)
def size_events(spark, folder):
    return P.size_event(P.size_progress(sized_events(spark, folder)))


@query(
    """SELECT event_id, event_type AS event, '{"message":' || CASE WHEN event_type = 'error' THEN 'null' ELSE '"step ' || event_id || '"' END || ',"user":' || user_id || '}' AS data FROM events"""
)
def json_events(spark, folder):
    text = F.when(F.col("event_type") != "error", F.concat(F.lit("step "), F.col("event_id").cast("string")))
    rows = table(spark, folder, "events")
    event = P.json_event(F.col("event_type"), text.alias("message"), F.col("user_id").alias("user"))
    return rows.select("event_id", event.alias("e")).select("event_id", "e.event", "e.data")


# --- displays ---------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (CAST(floor(o_totalprice) AS BIGINT) % 20000) / 2.0 END AS s, o_orderkey % 50 AS done, o_orderkey % 700 AS todo FROM orders),
e AS (SELECT *, CASE WHEN done > 0 AND s <> 0 THEN todo / (CAST(done AS DOUBLE) / s) END AS eta FROM t)
SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL ELSE {_sql_clock('CAST(s AS DOUBLE)', True)} END AS duration,
  CASE WHEN coalesce(eta, 0) <= 0 THEN 'Calculating...' ELSE {_sql_clock('eta', False)} END AS eta,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(s + 10 - 10 AS DOUBLE) END AS elapsed, 1.0 / (o_orderkey % 20 * 0.5 + 0.5) AS delay FROM e"""
)
def duration_display(spark, folder):
    k = F.col("o_orderkey")
    seconds = F.when(k % 13 != 0, F.floor("o_totalprice").cast("bigint") % 20000 / F.lit(2.0))
    rows = table(spark, folder, "orders").select("o_orderkey", seconds.alias("s"))
    s = F.col("s")
    eta = eta_seconds(k % 50, k % 700, s)
    return rows.select(
        "o_orderkey",
        format_duration(s).alias("duration"),
        format_eta(eta).alias("eta"),
        duration_seconds(F.when(k % 3 != 0, F.lit(10.0)), s + 10).alias("elapsed"),
        rate_delay(k % 20 * F.lit(0.5) + F.lit(0.5)).alias("delay"),
    )


@query(
    """SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
  CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS short FROM conversations"""
)
def text_display(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", escape_html(F.col("text")).alias("escaped"), truncate(F.col("text"), 60).alias("short")
    )


@query(
    """SELECT o_orderkey, CASE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(o_orderdate, '%b %-d') END
  || ' ' || strftime(o_orderdate, '%H:%M') AS shown FROM orders"""
)
def relative_dates(spark, folder):
    as_of = F.lit("2001-08-01 08:00:00").cast("timestamp_ntz")
    return table(spark, folder, "orders").select("o_orderkey", relative_day(F.col("o_orderdate"), as_of).alias("shown"))


# --- names ------------------------------------------------------------------------------------

_NAMES = ["re<p>ort?.pdf", " .. ", "a/b\\c:d.txt", "plain.csv", '"q"|*.', ".hidden", "data.tar.gz"]


def _named_files(spark, folder):
    i = F.col("doc_id")
    long_name = F.concat(F.repeat(F.lit("x"), 190), F.lit("_"), (i % 20).cast("string"), F.lit("_"), F.repeat(F.lit("y"), 20), F.lit(".docx"))
    name = F.when(i % 8 == 7, long_name).otherwise(pick(_NAMES, i % 8))
    return table(spark, folder, "documents").select(i.alias("seq"), name.alias("filename"))


_NAMED_SQL = f"""
files AS (SELECT doc_id AS seq, CASE WHEN doc_id % 8 = 7 THEN repeat('x', 190) || '_' || (doc_id % 20) || '_' || repeat('y', 20) || '.docx' ELSE {_sql_pick(_NAMES, '(doc_id % 8)')} END AS filename FROM documents),
clean AS (SELECT *, trim(regexp_replace(filename, '[<>:"/\\\\|?*]', '_', 'g'), ' .') AS c FROM files),
named AS (SELECT seq, filename, CASE WHEN c = '' THEN 'unnamed_file' WHEN length(c) > 200 THEN substr(c, 1, 200 - length(regexp_extract(c, '^\\.*[^.].*(\\.[^.]*)$', 1))) || regexp_extract(c, '^\\.*[^.].*(\\.[^.]*)$', 1) ELSE c END AS safe_name FROM clean),
parts AS (SELECT *, regexp_extract(safe_name, '^\\.*[^.].*(\\.[^.]*)$', 1) AS suffix FROM named),
turned AS (SELECT *, substr(safe_name, 1, length(safe_name) - length(suffix)) AS stem, row_number() OVER (PARTITION BY safe_name ORDER BY seq) - 1 AS k FROM parts)"""


@query(f"WITH {_NAMED_SQL} SELECT seq, safe_name, k AS collision, CASE WHEN k = 0 THEN safe_name ELSE stem || '_' || k || suffix END AS saved_name FROM turned")
def sanitize_and_number_names(spark, folder):
    return collision_names(_named_files(spark, folder)).select("seq", "safe_name", "collision", "saved_name")


@query(
    f"""WITH {_NAMED_SQL}, existing AS (SELECT DISTINCT stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END || suffix AS saved_name FROM turned WHERE k % 3 = 0 AND safe_name <> 'unnamed_file'),
fam AS (SELECT safe_name, any_value(stem) AS stem, any_value(suffix) AS suffix, count(*) AS n FROM turned GROUP BY 1),
cand AS (SELECT f.safe_name, g.i, CASE WHEN g.i = 0 THEN f.safe_name ELSE f.stem || '_' || g.i || f.suffix END AS saved_name FROM fam f, generate_series(0, (SELECT 2 * max(n) + 2 FROM fam)) g(i)),
free AS (SELECT safe_name, saved_name, row_number() OVER (PARTITION BY safe_name ORDER BY i) - 1 AS k FROM cand WHERE saved_name NOT IN (SELECT saved_name FROM existing))
SELECT t.seq, t.safe_name, f.saved_name FROM turned t JOIN free f ON f.safe_name = t.safe_name AND f.k = t.k"""
)
def unique_download_names(spark, folder):
    files = _named_files(spark, folder)
    numbered = collision_names(files)
    taken = numbered.filter((F.col("collision") % 3 == 0) & (F.col("safe_name") != "unnamed_file")).select("saved_name")
    return unique_names(files, taken).select("seq", "safe_name", "saved_name")


@query(
    """SELECT seq, CASE WHEN sanitized = '' THEN 'unnamed_file' ELSE sanitized END AS safe FROM
  (SELECT conv_id * 1000 + turn AS seq, trim(regexp_replace(role || ': ' || turn || '?' || ' .', '[<>:"/\\\\|?*]', '_', 'g'), ' .') AS sanitized FROM conversations)"""
)
def sanitized_names(spark, folder):
    name = F.concat("role", F.lit(": "), F.col("turn").cast("string"), F.lit("?"), F.lit(" ."))
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), sanitize_filename(name).alias("safe")
    )


@query(
    f"""WITH t AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS ex, o_orderkey % 5 <> 0 AS dir, o_orderkey % 7 <> 0 AS wr, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '/data' END AS p,
    CAST(floor(o_totalprice) AS BIGINT) * 100000 AS fr, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE (o_orderkey % 100) * 500000000 END AS need FROM orders),
c AS (SELECT *, CASE WHEN p = '' THEN 'empty' WHEN ex AND NOT dir THEN 'not_directory' WHEN NOT wr THEN 'not_writable' WHEN need > 0 AND fr < need THEN 'insufficient_space' WHEN NOT ex THEN 'not_exists' END AS code FROM t)
SELECT o_orderkey, code, code IS NULL OR code = 'not_exists' AS valid, CASE WHEN code = 'insufficient_space' THEN 'Not enough disk space. Need ' || {_sql_size('need', False)} || ', only ' || {_sql_size('fr', False)} || ' available' END AS message FROM c"""
)
def path_validation(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        k,
        check_path(
            k % 3 != 0, k % 5 != 0, k % 7 != 0, F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("/data")),
            F.floor("o_totalprice").cast("bigint") * 100000, F.when(k % 2 == 0, F.lit(0)).otherwise((k % 100) * 500000000),
        ).alias("r"),
    )
    return rows.select(
        "o_orderkey", "r.code", "r.valid", F.when(F.col("r.code") == "insufficient_space", F.col("r.message")).alias("message")
    )


# --- settings ---------------------------------------------------------------------------------

_KEYS = ["max_pages_per_scan", "ai_model", "max_crawl_depth", "ai_api_key", "unknown_key"]


def _stored_settings(spark, folder):
    """Per user, the latest value saved under each key."""
    e = F.col("event_id")
    key = pick(_KEYS, e)
    value = (
        F.when(key.isin("max_pages_per_scan", "max_crawl_depth"), (e % 17000 - 100).cast("string"))
        .otherwise(F.concat(F.lit('"v'), (e % 90).cast("string"), F.lit('"')))
    )
    saved = table(spark, folder, "events").select("user_id", e, key.alias("key"), value.alias("value"))
    return saved.groupBy("user_id", "key").agg(F.max_by("value", "event_id").alias("value"))


_SETTINGS_SQL = f"""
saved AS (SELECT user_id, event_id, {_sql_pick(_KEYS, 'event_id')} AS key FROM events),
valued AS (SELECT *, CASE WHEN key IN ('max_pages_per_scan', 'max_crawl_depth') THEN CAST(event_id % 17000 - 100 AS VARCHAR) ELSE '"v' || (event_id % 90) || '"' END AS value FROM saved),
stored AS (SELECT user_id, key, arg_max(value, event_id) AS value FROM valued GROUP BY 1, 2)"""

_DEFAULTS_SQL = ", ".join(f"('{k}', '{json.dumps(v)}')" for k, v in SETTING_DEFAULTS.items())


@query(
    f"""WITH {_SETTINGS_SQL}, defaults(key, value) AS (VALUES {_DEFAULTS_SQL}), owners AS (SELECT DISTINCT user_id FROM stored)
SELECT o.user_id, d.key, CASE WHEN d.key = 'ai_api_key' AND coalesce(s.value, d.value) <> '""' THEN '"{MASKED_KEY}"' ELSE coalesce(s.value, d.value) END AS value
FROM owners o CROSS JOIN defaults d LEFT JOIN stored s ON s.user_id = o.user_id AND s.key = d.key"""
)
def settings_effective(spark, folder):
    wide = G.effective_by_owner(_stored_settings(spark, folder), "user_id")
    return G.masked(wide.unpivot(["user_id"], list(SETTING_DEFAULTS), "key", "value"))


@query(
    "WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey - 50 AS v, l_discount * 150 - 1 AS r, CAST(l_quantity AS BIGINT) - 5 AS q FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"CAST(least({hi}, greatest({lo}, {'r' if k == 'requests_per_second' else 'v'})) AS {'DOUBLE' if k == 'requests_per_second' else 'BIGINT'}) AS {k}"
        for k, (lo, hi) in SETTING_BOUNDS.items()
    )
    + ", CAST(least(4, greatest(1, q)) AS BIGINT) AS default_crawl_depth FROM raw"
)
def settings_clamped(spark, folder):
    value = {k: F.col("l_partkey") - 50 for k in SETTING_BOUNDS}
    value["requests_per_second"] = F.col("l_discount") * 150 - 1
    columns = [G.clamp_setting(k, v).cast("double" if k == "requests_per_second" else "bigint").alias(k) for k, v in value.items()]
    depth = G.clamp_setting("default_crawl_depth", F.col("l_quantity").cast("bigint") - 5, F.lit(4).cast("bigint"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *columns, depth.alias("default_crawl_depth"))


_UPDATES = [
    ("max_pages_per_scan", "20000"), ("requests_per_second", "0.1"), ("default_crawl_depth", "9"), ("max_crawl_depth", "3"),
    ("ai_api_key", json.dumps(MASKED_KEY)), ("ai_model", '"  m2 "'), ("mongodb_uri", '""'), ("stirling_pdf_url", '"http://x/ "'),
    ("request_timeout", "null"), ("nonsense", "1"), ("mongodb_database", '" "'), ("ai_api_url", '""'),
]


@query(
    f"""WITH {_SETTINGS_SQL}, latest AS (SELECT key, arg_max(value, user_id) AS value FROM stored WHERE key = 'ai_model' GROUP BY 1),
defaults(key, value) AS (VALUES {_DEFAULTS_SQL}), cur AS (SELECT d.key, coalesce(l.value, d.value) AS value FROM defaults d LEFT JOIN latest l ON l.key = d.key)
SELECT key, CASE key WHEN 'max_pages_per_scan' THEN '10000' WHEN 'requests_per_second' THEN '0.5' WHEN 'default_crawl_depth' THEN '9' WHEN 'max_crawl_depth' THEN '3'
  WHEN 'ai_model' THEN '"m2"' WHEN 'stirling_pdf_url' THEN '"http://x"' WHEN 'mongodb_database' THEN '"documents"' ELSE value END AS value FROM cur"""
)
def settings_update(spark, folder):
    stored = _stored_settings(spark, folder).filter("key = 'ai_model'")
    latest = stored.groupBy("key").agg(F.max_by("value", "user_id").alias("value"))
    current = G.effective(G.defaults(spark), latest)
    return G.apply_updates(current, spark.createDataFrame(_UPDATES, "key string, value string"))


# --- sheets -----------------------------------------------------------------------------------


def _customer_sheets(spark, folder):
    """One sheet per market segment, rows by key; every ninth row is blank and some cells are missing."""
    k = F.col("c_custkey")
    cells = F.array(
        F.col("c_name"), F.when(k % 4 != 0, F.col("c_nationkey").cast("string")), F.col("c_mktsegment"),
        F.when(k % 5 != 0, F.floor("c_acctbal").cast("bigint").cast("string")),
    )
    empty = F.array(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"), F.lit(""))
    return table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("sheet"), k.alias("row_index"), F.when(k % 9 != 0, cells).otherwise(empty).alias("cells")
    )


_SHEET_SQL = """
filled AS (SELECT c_mktsegment AS sheet, c_custkey AS row_index, c_name || ' | ' || CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END || ' | ' || c_mktsegment || ' | ' ||
    CASE WHEN c_custkey % 5 <> 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END AS line FROM customer WHERE c_custkey % 9 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_index) AS r, count(*) OVER (PARTITION BY sheet) AS n FROM filled)"""


@query(
    f"""WITH {_SHEET_SQL} SELECT sheet, any_value(n) AS row_count, max(line) FILTER (WHERE r = 1) AS headers, string_agg(line, '#' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 6) AS samples,
  any_value(n) - 6 AS more_rows, '--- Sheet: ' || sheet || ' (' || any_value(n) || ' rows) ---' || chr(10) || '  Column headers: ' || max(line) FILTER (WHERE r = 1) || chr(10) || '  Sample data (5 of ' || (any_value(n) - 1) || ' data rows):' || chr(10) ||
  string_agg('    ' || line, chr(10) ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 6) || chr(10) || '  ... and ' || (any_value(n) - 6) || ' more rows' AS profile
FROM ranked GROUP BY sheet"""
)
def sheet_profiles(spark, folder):
    profile = sheet_profile(_customer_sheets(spark, folder))
    return profile.withColumn("samples", F.array_join("samples", "#"))


@query(
    """WITH rows AS (SELECT c_nationkey AS file, length(c_mktsegment) AS i, c_mktsegment AS sheet, c_custkey AS r, c_custkey % 9 <> 0 AS filled, c_name || ' | ' || c_mktsegment AS line FROM customer),
s AS (SELECT file, i, sheet, count(*) FILTER (WHERE filled) AS n FROM rows GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY r) AS rk FROM rows WHERE filled),
t AS (SELECT s.file, s.i, s.sheet, '--- Sheet: ' || s.sheet || ' (' || any_value(n) || ' rows) ---' || chr(10) || CASE WHEN any_value(n) = 0 THEN '  (empty sheet)' ELSE '  Column headers: ' || max(line) FILTER (WHERE rk = 1) ||
    CASE WHEN any_value(n) > 1 THEN chr(10) || '  Sample data (' || least(any_value(n) - 1, 5) || ' of ' || (any_value(n) - 1) || ' data rows):' || chr(10) || string_agg('    ' || line, chr(10) ORDER BY rk) FILTER (WHERE rk BETWEEN 2 AND 6) ELSE '' END ||
    CASE WHEN any_value(n) > 6 THEN chr(10) || '  ... and ' || (any_value(n) - 6) || ' more rows' ELSE '' END END AS profile
  FROM s LEFT JOIN k ON k.file = s.file AND k.sheet = s.sheet GROUP BY 1, 2, 3)
SELECT file, 'Spreadsheet with ' || count(*) || ' sheet(s): ' || string_agg(sheet, ', ' ORDER BY i, sheet) || chr(10) || string_agg(chr(10) || profile, chr(10) ORDER BY i, sheet) AS profile FROM t GROUP BY file"""
)
def workbook_profiles(spark, folder):
    k = F.col("c_custkey")
    cells = F.array("c_name", "c_mktsegment")
    rows = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("file"), F.length("c_mktsegment").alias("sheet_index"), F.col("c_mktsegment").alias("sheet"),
        k.alias("row_index"), F.when(k % 9 != 0, cells).otherwise(F.array(F.lit(""), F.lit(""))).alias("cells"),
    )
    return workbook_profile(rows, "file")


@query(
    f"""WITH {STORE_SQL} SELECT _id, filename FROM store ORDER BY filename, _id LIMIT 25 OFFSET 50"""
)
def third_result_page(spark, folder):
    return R.result_page(stored_documents(spark, folder).select("_id", "filename"), ["filename", "_id"], 3, 25)


@query(
    """SELECT c_mktsegment AS sheet, CAST(c_custkey AS BIGINT) AS row_index, CASE WHEN c_custkey % 9 = 0 THEN ' | ' ELSE concat_ws(' | ', c_name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) END, c_mktsegment,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END) END AS line FROM customer
UNION ALL SELECT DISTINCT c_mktsegment, CAST(-1 AS BIGINT), '[Sheet: ' || c_mktsegment || ']' FROM customer"""
)
def sheet_lines(spark, folder):
    return sheet_text(_customer_sheets(spark, folder))


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ',' ELSE chr(9) END AS sep, replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, ' ', chr(9)) END, '"', '') AS t FROM documents),
r AS (SELECT *, list_filter(string_split(t, chr(10)), lambda line: regexp_replace(line, '[\\s,]+', '', 'g') <> '') AS rows FROM d),
s AS (SELECT doc_id, length(t) - length(replace(t, chr(10), '')) AS line_count, list_transform(rows, lambda line: array_to_string(string_split(line, sep), ' | ')) AS lines FROM r)
SELECT doc_id, CAST(line_count AS BIGINT) AS line_count, lines[1] AS headers, coalesce(array_to_string(list_slice(lines, 2, 6), '#'), '') AS samples,
  'CSV file with approximately ' || line_count || ' rows' || chr(10) || 'Column headers: ' || lines[1] ||
  CASE WHEN len(lines) > 1 THEN chr(10) || 'Sample data (' || least(len(lines) - 1, 5) || ' rows):' || chr(10) || array_to_string(list_transform(list_slice(lines, 2, 6), lambda x: '  ' || x), chr(10)) ELSE '' END ||
  CASE WHEN line_count > 6 THEN chr(10) || '... and approximately ' || (line_count - 6) || ' more rows' ELSE '' END AS profile FROM s"""
)
def csv_profiles(spark, folder):
    even = F.col("doc_id") % 2 == 0
    body = F.when(even, F.col("text")).otherwise(F.replace("text", F.lit(" "), F.lit("\t")))
    files = table(spark, folder, "documents").select(
        "doc_id",
        F.replace(body, F.lit('"'), F.lit("")).alias("text"),
        F.when(even, F.lit(".csv")).otherwise(F.lit(".tsv")).alias("extension"),
    )
    return csv_profile(files, ["doc_id"]).withColumn("samples", F.array_join("samples", "#"))


# --- logs -------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT e.event_id AS seq, p.url, CASE WHEN event_id % 2 = 0 THEN 'TIMEOUT' ELSE 'HTTP ' || (400 + event_id % 5) END AS reason FROM events e JOIN pages p ON p.page_id = e.user_id WHERE event_type = 'error')
SELECT min(seq) AS seq, url, arg_min(reason, seq) || ' | ' || url AS line FROM f GROUP BY url"""
)
def inaccessible_log(spark, folder):
    e = F.col("event_id")
    reason = F.when(e % 2 == 0, F.lit("TIMEOUT")).otherwise(F.concat(F.lit("HTTP "), (e % 5 + 400).cast("string")))
    events = table(spark, folder, "events").filter("event_type = 'error'").select(e.alias("seq"), F.col("user_id").alias("page_id"), reason.alias("reason"))
    return R.inaccessible_log(events.join(table(spark, folder, "pages").select("page_id", "url"), "page_id"))


@query(
    """SELECT url, max(event_id) AS last_used FROM events e JOIN pages p ON p.page_id = e.user_id GROUP BY 1 ORDER BY 2 DESC LIMIT 5"""
)
def recent_urls(spark, folder):
    visits = table(spark, folder, "events").select("event_id", F.col("user_id").alias("page_id"))
    return R.recent_urls(visits.join(table(spark, folder, "pages").select("page_id", "url"), "page_id"), "event_id")


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS value FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(value, ' ', '') WHEN 2 THEN '"' || value || '"' ELSE value END AS decoded FROM s"""
)
def settings_decoded(spark, folder):
    """Stored values read as JSON, or as the text they are where they are no JSON."""
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 2, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, folder, "events").select("event_id", F.to_json(G.decode(value)).alias("decoded"))


@query(
    """SELECT 'kept' AS part, key, value FROM (SELECT 'k' || c_custkey AS key, '"' || c_mktsegment || '"' AS value FROM customer) WHERE key <> 'k7' AND key <> 'k8'
UNION ALL SELECT 'kept', 'k8', '5'"""
)
def settings_removed(spark, folder):
    """One stored setting is deleted, and one is set anew."""
    stored = table(spark, folder, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("value")
    )
    return G.delete_setting(G.set_setting(stored, "k8", 5), "k7").select(F.lit("kept").alias("part"), "key", "value")
