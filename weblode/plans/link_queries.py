"""Queries over pages, links and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.functions import url as U
from weblode.functions.html import is_minimal, is_script_redirect
from weblode.functions.requests import check_depth, check_url
from weblode.functions.sizes import format_size, format_size_history, format_size_ui
from weblode.functions.html import with_page_links
from weblode.functions.text import mime_type, type_label
from weblode.lookups import (
    ALL_EXTENSIONS,
    COMMON_EXTENSIONS,
    DEFAULT_ICON,
    FILE_ICONS,
    HTML_EXTENSIONS,
    MIME_TYPES,
    TRACKING_PARAMS,
    TYPE_LABELS,
    lookup,
)
from weblode.operators import links as L
from weblode.plans.fixtures import RecordedClock, _sql_case, _sql_literal, _sql_pick, cross_links, pick, recorded_response
from weblode.plans.registry import query
from weblode.session import scratch_path
from weblode.sources.paced import HostPace, request_slotted
from weblode.sources.tables import table


def _in(values) -> str:
    return "(" + ", ".join(_sql_literal(v) for v in values) + ")"


def _sql_key(url: str) -> str:
    """Crawl key of a simple absolute URL."""
    netloc = f"lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1))"
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    query_ = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (
        f"array_to_string(list_filter(string_split({query_}, '&'), "
        f"lambda kv: kv <> '' AND lower(split_part(kv, '=', 1)) NOT IN {_in(TRACKING_PARAMS)}), '&')"
    )
    return (
        f"regexp_extract({url}, '^([a-z]+://)', 1) || {netloc} || "
        f"CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/+$', '') END || "
        f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    )


def _sql_site(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"


def _sql_ext(name: str) -> str:
    """Extension of a file name."""
    ext = f"regexp_replace('.' || lower(regexp_extract({name}, '([^.]*)$', 1)), '[^a-z0-9.]', '', 'g')"
    return f"CASE WHEN contains({name}, '.') THEN {ext} ELSE '' END"


_LINKS_SQL = r"""
cleaned AS (
  SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g') AS html
  FROM pages),
hrefs AS (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM cleaned),
links AS (
  SELECT DISTINCT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link
  FROM hrefs WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
named AS (
  SELECT *, CASE WHEN regexp_extract(link, '([^/]*)$', 1) = '' THEN 'unknown' ELSE url_decode(regexp_extract(link, '([^/]*)$', 1)) END AS filename
  FROM links)
"""


@query(
    f"""WITH {_LINKS_SQL}, classed AS (
  SELECT url, link, {_sql_site('link')} AS site, {_sql_ext('filename')} AS extension, {_sql_key('link')} AS target FROM named)
SELECT site, CASE WHEN extension IN {_in(COMMON_EXTENSIONS)} THEN 'document'
    WHEN extension = '' OR extension IN {_in(HTML_EXTENSIONS)} THEN 'page' ELSE 'other' END AS link_class,
  CAST(count(DISTINCT (url, link)) AS BIGINT) AS links, CAST(count(DISTINCT url) AS BIGINT) AS pages,
  CAST(count(DISTINCT (url, target)) AS BIGINT) AS targets
FROM classed GROUP BY 1, 2"""
)
def link_profile(spark, folder):
    return L.link_profile(table(spark, folder, "pages"))


@query(f"SELECT page_id, {_sql_key('url')} AS crawl_key FROM pages")
def page_url_normalized(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.crawl_key(F.col("url")).alias("crawl_key"))


@query(
    f"""SELECT {_sql_site('url')} AS site, CAST(count(*) AS BIGINT) AS pages,
  CAST(count(*) FILTER (WHERE url LIKE 'https://%') AS BIGINT) AS secure FROM pages GROUP BY 1"""
)
def page_site_counts(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.groupBy(U.site_of(F.col("url")).alias("site")).agg(
        F.count("*").alias("pages"), F.count_if(U.scheme_of(F.col("url")) == "https").alias("secure")
    )


_CROSS_SQL = """
total AS (SELECT count(*) AS n FROM pages),
steps AS (
  SELECT p.url, v.b AS position, CASE v.b WHEN 3 THEN page_id WHEN 2 THEN (page_id * 3 + 1) % n
    ELSE (page_id * 3 + 1 + v.b) % n END AS target
  FROM pages p, total, (VALUES (0), (1), (2), (3)) v(b)),
cross_links AS (SELECT s.url, s.position, t.url AS link FROM steps s JOIN pages t ON t.page_id = s.target)"""


@query(
    f"""WITH {_CROSS_SQL}, visited AS (SELECT DISTINCT {_sql_key('url')} AS key FROM pages WHERE url LIKE 'https://%'),
keyed AS (SELECT c.url, position, {_sql_key('link')} AS key,
    regexp_matches(link, '\\?replytocom=|/feed/\\?|/feed$') AS pattern, {_sql_site('link')} = {_sql_site('c.url')} AS internal
  FROM cross_links c),
judged AS (SELECT k.*, v.key IS NOT NULL AS seen,
    row_number() OVER (PARTITION BY k.url, k.key ORDER BY position) AS turn
  FROM keyed k LEFT JOIN visited v ON v.key = k.key)
SELECT url, CAST(count(*) FILTER (WHERE NOT pattern AND NOT seen AND internal AND turn = 1) AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE pattern OR seen OR (internal AND turn > 1)) AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE NOT pattern AND NOT seen AND NOT internal) AS BIGINT) AS external
FROM judged GROUP BY url"""
)
def internal_external_links(spark, folder):
    pages = table(spark, folder, "pages").select("url")
    visited = pages.filter(U.scheme_of(F.col("url")) == "https").select(U.crawl_key(F.col("url")).alias("key"))
    return L.link_counters(cross_links(spark, folder), visited)


@query(
    f"""WITH {_LINKS_SQL}, visited AS (SELECT DISTINCT {_sql_key('url')} AS key FROM pages),
queued AS (SELECT DISTINCT {_sql_key('link')} AS key FROM named WHERE contains(link, 'n')),
keys AS (SELECT DISTINCT {_sql_key('link')} AS key FROM named)
SELECT key FROM keys WHERE key NOT IN (SELECT key FROM visited) AND key NOT IN (SELECT key FROM queued)"""
)
def unvisited_links_anti(spark, folder):
    pages = table(spark, folder, "pages")
    links = L.extract_links(pages).select("link", U.crawl_key(F.col("link")).alias("key"))
    queued = links.filter(F.contains("link", F.lit("n"))).select("key").distinct()
    visited = pages.select(U.crawl_key(F.col("url")).alias("key")).distinct()
    return links.select("key").distinct().join(visited, "key", "left_anti").join(queued, "key", "left_anti")


_VARIANTS = ["", "?replytocom=5", "/feed", "/feed/?x=1", "/feed/", "/x?a=1&replytocom=2"]


@query(
    f"""WITH v AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || {_sql_pick(_VARIANTS, 'page_id')} AS candidate FROM pages)
SELECT page_id, candidate, regexp_matches(candidate, '\\?replytocom=|/feed/\\?|/feed$') AS skipped FROM v"""
)
def skip_url_filter(spark, folder):
    candidate = F.concat(F.regexp_replace("url", "[?#].*$", ""), pick(_VARIANTS, F.col("page_id")))
    rows = table(spark, folder, "pages").select("page_id", candidate.alias("candidate"))
    return rows.withColumn("skipped", U.is_skipped(F.col("candidate")))


@query(
    """WITH v AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<script>Window.Location.href="' || url || '"</script>'
    WHEN 1 THEN '<p>moved to ' || url || '</p>' ELSE html END AS html FROM pages),
c AS (SELECT page_id, html, len(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a\\s[^>]*href="([^"]*)"', 1)) AS links FROM v)
SELECT page_id, length(html) < 500 AND regexp_matches(lower(html), 'window\\.location|window\\.onload|document\\.location|location\\.href|location\\.replace') AS is_redirect,
  links = 0 AND length(html) < 2000 AS is_minimal FROM c"""
)
def script_or_minimal_pages(spark, folder):
    markup = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script>Window.Location.href="'), "url", F.lit('"</script>')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<p>moved to "), "url", F.lit("</p>")))
        .otherwise(F.col("html"))
    )
    pages = table(spark, folder, "pages").select("page_id", "url", markup.alias("html"))
    scanned = L.with_links(pages)
    return scanned.select(
        "page_id",
        is_script_redirect(F.col("html")).alias("is_redirect"),
        is_minimal(F.col("html"), F.size("found")).alias("is_minimal"),
    )


@query(f"WITH {_LINKS_SQL} SELECT p.url, CAST(count(n.link) AS INT) AS links FROM pages p LEFT JOIN named n ON n.url = p.url GROUP BY 1")
def distinct_links_per_page(spark, folder):
    return L.distinct_links(table(spark, folder, "pages"))


@query(
    f"""WITH {_LINKS_SQL}, e AS (SELECT url, link, {_sql_ext('filename')} AS extension FROM named),
m AS (SELECT url, count(*) FILTER (WHERE extension = '' OR extension IN {_in(HTML_EXTENSIONS)}) AS page_links,
    count(*) FILTER (WHERE extension IN {_in(ALL_EXTENSIONS)}) AS document_links, count(*) AS n FROM e GROUP BY 1)
SELECT p.url, CAST(coalesce(page_links, 0) AS INT) AS page_links, CAST(coalesce(document_links, 0) AS INT) AS document_links,
  coalesce(n, 0) = 0 AND length(html) < 2000 AS needs_render FROM pages p LEFT JOIN m ON m.url = p.url"""
)
def page_scan(spark, folder):
    scanned = L.scan_pages(table(spark, folder, "pages"), "all")
    return scanned.select(
        "url", F.size("page_links").alias("page_links"), F.size("document_links").alias("document_links"), "needs_render"
    )


_FILE_TAILS = [
    "/files/Annual%20Report+v1.PDF;x=1?d=1", "/a/b.tar.gz", "/docs/", "/x/data.XLSX#s1", "/est.", "/name.toolongext1",
    "/p.php?id=7", "/photo.jpeg", "/Makefile", "/k.odt", "/w/%41%2Ezip", "/q.DOC;v=2", "/t.t_x-t",
]


@query(
    f"""WITH v AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {_sql_pick(_FILE_TAILS, 'page_id')} AS address FROM pages),
s AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(address, '[?#].*$', ''), ';[^/]*$', ''), '([^/]*)$', 1) AS seg FROM v),
f AS (SELECT *, CASE WHEN seg = '' THEN 'unknown' ELSE url_decode(seg) END AS filename FROM s),
e AS (SELECT *, {_sql_ext('filename')} AS extension FROM f)
SELECT page_id, address, filename, extension, {_sql_case(TYPE_LABELS, "CASE WHEN starts_with(extension, '.') THEN extension ELSE '.' || extension END", "upper(ltrim(extension, '.')) || ' File'")} AS label,
  {_sql_case(MIME_TYPES, 'extension', "'application/octet-stream'")} AS mime, {_sql_case(FILE_ICONS, 'extension', "'file'")} AS icon,
  extension = '' OR extension IN {_in(HTML_EXTENSIONS)} AS is_page, extension IN {_in(COMMON_EXTENSIONS)} AS is_common,
  extension IN {_in(ALL_EXTENSIONS)} AS is_file, extension = '.pdf' AS is_pdf FROM e"""
)
def url_filename_extension_label(spark, folder):
    address = F.concat(
        U.scheme_of(F.col("url")), F.lit("://"), U.netloc_of(F.col("url")), pick(_FILE_TAILS, F.col("page_id"))
    )
    rows = table(spark, folder, "pages").select("page_id", address.alias("address"))
    named = L.with_extension(rows, "address")
    ext = F.col("extension")
    return named.withColumns({
        "label": type_label(ext),
        "mime": mime_type(ext),
        "icon": lookup(FILE_ICONS, ext, DEFAULT_ICON),
        "is_page": U.is_page_extension(ext),
        "is_common": L.allowed_extension(ext, "common"),
        "is_file": L.allowed_extension(ext, "all"),
        "is_pdf": L.allowed_extension(ext, "pdf_only"),
    })


_REFERENCES = [
    "../x/./y.pdf", "?q=1", "//Cdn.Example.com/a/../b", "a/b.html#top", "/r/../s/", "https://Other.example.net/z?k=1#f",
    "./", "ftp://files.example.com/f.txt", ";v=1", "", "../../../up",
]


def _sql_resolved() -> str:
    scheme = "regexp_extract(url, '^([a-z]+:)', 1)"
    root = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
    path = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"regexp_replace({path}, '[^/]*$', '')"
    parent = f"regexp_replace({folder}, '[^/]+/$', '')"
    whole = "regexp_replace(url, '#.*$', '')"
    cases = [
        f"{root} || {parent} || 'x/y.pdf'",
        f"{root} || {path} || '?q=1'",
        f"{scheme} || '//Cdn.Example.com/a/../b'",
        f"{root} || {folder} || 'a/b.html'",
        f"{root} || '/s/'",
        "'https://Other.example.net/z?k=1'",
        f"{root} || {folder}",
        "'https://ftp://files.example.com/f.txt'",
        f"{root} || {folder} || ';v=1'",
        whole,
        f"{root} || '/up'",
    ]
    return "CASE page_id % 11 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


@query(f"SELECT page_id, {_sql_pick(_REFERENCES, 'page_id')} AS reference, {_sql_resolved()} AS resolved FROM pages")
def resolved_references(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", "url", pick(_REFERENCES, F.col("page_id")).alias("reference"))
    return rows.select("page_id", "reference", U.normalize_url(F.col("reference"), F.col("url")).alias("resolved"))


_REQUESTS = ["", "  ", "no host", "spaces", "single", "localhost", "port", "nodot", "plain", "short"]


@query(
    """WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url, CASE page_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN 'https://' WHEN 2 THEN url || '/a b'
    WHEN 3 THEN 'h' || page_id || '.c/x' WHEN 4 THEN 'localhost:8000/p' || page_id WHEN 5 THEN 'host' || page_id || '/x'
    WHEN 6 THEN ' ' || regexp_replace(url, '^[a-z]+://', '') || ' ' WHEN 7 THEN 'http://u@Host' || page_id || ':80' WHEN 8 THEN 'ftp://' || page_id || '.example.com' ELSE url END AS request FROM pages),
t AS (SELECT *, trim(request) AS address FROM r),
f AS (SELECT *, CASE WHEN regexp_matches(address, '^https?://') THEN address ELSE 'https://' || address END AS full_url FROM t),
h AS (SELECT *, lower(regexp_extract(regexp_extract(full_url, '^[a-z]+://(?:[^/?#]*@)?([^/?#]*)', 1), '^([^:]*)', 1)) AS hostname FROM f),
e AS (SELECT *, CASE WHEN address = '' THEN 'Please enter a website address'
    WHEN hostname = '' THEN 'Please enter a valid website address (e.g. example.com)'
    WHEN NOT contains(hostname, '.') AND hostname <> 'localhost' THEN 'That doesn''t look like a complete website address. Did you mean ' || hostname || '.com?'
    WHEN contains(full_url, ' ') THEN 'The website address contains spaces. Please check for typos and try again'
    WHEN length(regexp_extract(hostname, '\\.([^.]*)$', 1)) < 2 AND contains(hostname, '.') THEN 'The website address doesn''t have a valid ending (like .com or .org). Please check the address and try again' END AS error FROM h)
SELECT page_id, CASE WHEN error IS NULL THEN full_url END AS url, error,
  CASE WHEN page_id % 14 < 1 THEN 'max_depth must be >= 1' WHEN page_id % 14 > 10 THEN 'max_depth must be <= 10' END AS depth_error FROM e"""
)
def validate_scan_requests(spark, folder):
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    shapes = [
        F.lit("  "), F.lit("https://"), F.concat("url", F.lit("/a b")), F.concat(F.lit("h"), text, F.lit(".c/x")),
        F.concat(F.lit("localhost:8000/p"), text), F.concat(F.lit("host"), text, F.lit("/x")),
        F.concat(F.lit(" "), bare, F.lit(" ")), F.concat(F.lit("http://u@Host"), text, F.lit(":80")),
        F.concat(F.lit("ftp://"), text, F.lit(".example.com")), F.col("url"),
    ]
    request = F.element_at(F.array(*shapes), (k % 10).cast("int") + 1)
    checked = table(spark, folder, "pages").select("page_id", check_url(request).alias("r"))
    return checked.select("page_id", "r.url", "r.error", check_depth(k % 14, F.lit(10)).alias("depth_error"))


_SCALED = "CAST(floor(l_extendedprice) AS BIGINT) * CAST(pow(2, l_linenumber * 5) AS BIGINT)"


def _sql_size(value: str, rounded: bool) -> str:
    def shown(power: int, unit: str) -> str:
        scaled = f"CAST({value} AS DOUBLE) / {1024 ** power}"
        return f"printf('%.1f', {f'round({scaled}, 1)' if rounded else scaled}) || ' {unit}'"

    return (
        f"CASE WHEN {value} < 0 THEN NULL WHEN {value} < 1024 THEN {value} || ' B' WHEN {value} < {1024**2} THEN {shown(1, 'KB')} "
        f"WHEN {value} < {1024**3} THEN {shown(2, 'MB')} WHEN {value} < {1024**4} THEN {shown(3, 'GB')} ELSE {shown(4, 'TB')} END"
    )


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN -CAST(l_quantity AS BIGINT) ELSE {_SCALED} END AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, size, {_sql_size('size', False)} AS display, {_sql_size('size', True)} AS ui_display,
  CASE WHEN size IS NULL OR size = 0 THEN '0 B' ELSE {_sql_size('size', True)} END AS history_display FROM s"""
)
def file_size_display(spark, folder):
    power = F.element_at(F.array(*[F.lit(2 ** (5 * n)) .cast("bigint") for n in range(8)]), F.col("l_linenumber") + 1)
    size = (
        F.when(F.col("l_quantity") < 3, F.lit(None).cast("bigint"))
        .when(F.col("l_quantity") < 5, -F.col("l_quantity").cast("bigint"))
        .otherwise(F.floor("l_extendedprice").cast("bigint") * power)
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"))
    s = F.col("size")
    return rows.select(
        "*",
        format_size(s).alias("display"),
        format_size_ui(s).alias("ui_display"),
        format_size_history(s).alias("history_display"),
    )


@query(
    """WITH s AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc FROM pages),
f AS (SELECT *, CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '' THEN 'unknown' ELSE url_decode(regexp_extract(path, '([^/]*)$', 1)) END AS fn FROM s)
SELECT page_id, CASE WHEN length(url) <= 38 THEN url WHEN length(netloc || '/.../' || fn) <= 38 THEN netloc || '/.../' || fn ELSE substr(url, 1, 35) || '...' END AS short_url,
  CASE WHEN length(netloc || path) > 24 THEN substr(netloc || path, 1, 21) || '...' ELSE netloc || path END AS host_path,
  regexp_matches(url, '^https?://[^/]') AS valid FROM f"""
)
def url_display(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        U.display_url(url, 38).alias("short_url"),
        U.display_host_path(url, 24).alias("host_path"),
        U.is_valid_url(url).alias("valid"),
    )


# --- markup that browsers repair --------------------------------------------------------------


@query(
    """SELECT page_id, unnest(['/e/' || page_id || '.pdf', 'https://x.example.com/o.swf', 'frame ' || page_id || '.html']) AS href FROM pages"""
)
def embedded_links(spark, folder):
    """Embedded sources, appended to every page since the given ones have none."""
    key = F.col("page_id").cast("string")
    more = F.concat(
        F.lit('<embed src="/e/'), key, F.lit(".pdf\"><object src='https://x.example.com/o.swf'></object><iframe width=1 src=\"frame "),
        key, F.lit('.html"></iframe>'),
    )
    pages = table(spark, folder, "pages").select("page_id", F.concat("html", more).alias("html"))
    found = with_page_links(pages).select("page_id", F.explode("found").alias("link"))
    return found.filter("link.kind = 'embed'").select("page_id", "link.href")


@query(
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="[^"]+"')) AS BIGINT) AS links FROM pages"""
)
def broken_markup_links(spark, folder):
    """Links of pages that end in an unended script, comment, title or tag: nothing inside those is a link."""
    ends = ['<script>var a="<a href=\'/s.pdf\'>"; <a href="/t.pdf">', '<!-- <a href="/c.pdf">', '<title><a href="/n.pdf">', '<a href="/u.pdf']
    tail = F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, folder, "pages").select("page_id", F.concat("html", tail).alias("html"))
    return with_page_links(pages).select("page_id", F.size("found").cast("bigint").alias("links"))


@query(
    """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, page_id % 3 = 0 AS early FROM pages),
r AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY NOT early, page_id) - 1 AS rank FROM p)
SELECT page_id, host, 1700000000000 + rank * 600 AS slot_ms, 1700000000000 + rank * 600 AS sent_ms,
  CAST(CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS INT) AS status FROM r"""
)
def host_paced_requests(spark, folder):
    """All pages requested from recorded responses in two runs, no host more than twice in any second."""
    pages = table(spark, folder, "pages").select(
        "page_id", F.col("page_id").alias("seq"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url")
    )
    pace = HostPace(spark, scratch_path(spark, "pace"), 2.0)
    start, answers = 1_700_000_000_000, []
    for early in (True, False):
        # The second run counts on from where the first one left each host.
        clock = RecordedClock(start / 1000)
        slotted = pace.schedule(pages.filter((F.col("page_id") % 3 == 0) == early), start)
        answers.append(request_slotted(slotted, recorded_response, 8, clock=clock, sleep=clock.sleep, threads=1))
    sent = answers[0].unionByName(answers[1]).withColumn("page_id", F.substring_index("url", "#", -1).cast("bigint"))
    return sent.select("page_id", "host", "slot_ms", "sent_ms", "status")
