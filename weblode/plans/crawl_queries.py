"""Queries that walk the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.operators import crawl as C
from weblode.operators.dedup import dedup_by_name
from weblode.plans.fixtures import GRAPH_SQL, link_graph, site_markup, site_pages
from weblode.plans.registry import query
from weblode.sources.tables import table

_REACH = f"""WITH RECURSIVE {GRAPH_SQL},
walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN link_graph e ON e.src = w.node WHERE w.depth < {{limit}})"""


@query(_REACH.format(limit=10) + " SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node")
def bfs_min_depth(spark, folder):
    roots = table(spark, folder, "pages").filter("page_id = 0").select(F.col("page_id").alias("node"))
    return C.bfs_depths(link_graph(spark, folder), roots, 10)


@query(_REACH.format(limit=3) + " SELECT depth, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node) GROUP BY depth")
def bfs_bounded_levels(spark, folder):
    roots = table(spark, folder, "pages").filter("page_id = 0").select(F.col("page_id").alias("node"))
    return C.bfs_depths(link_graph(spark, folder), roots, 3).groupBy("depth").agg(F.count("*").alias("nodes"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT e.dst FROM walk w JOIN link_graph e ON e.src = w.node) SELECT node FROM walk")
def bfs_all_reachable(spark, folder):
    """Everything reachable, however many levels that takes."""
    roots = table(spark, folder, "pages").filter("page_id = 0").select(F.col("page_id").alias("node"))
    return C.bfs_depths(link_graph(spark, folder), roots, None).select("node")


_SITE = _REACH.format(limit=4) + r""",
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
cleaned AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g') AS html FROM pages),
words AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM cleaned),
found AS (SELECT 'https://site.example.com/p/' || node AS key, depth FROM nodes
  UNION ALL SELECT 'https://site.example.com' || regexp_replace(w.href, '/+$', ''), n.depth + 1 FROM words w JOIN nodes n ON n.node = w.page_id
    WHERE n.depth < 4 AND NOT contains(w.href, '.') AND href <> '/')"""


def _site_links(spark, folder):
    """The site's link table, written once: each level of a crawl reads it instead of the markup."""
    return C.stored_links(site_markup(spark, folder))


@query(_SITE + " SELECT key, CAST(min(depth) AS INT) AS depth FROM found GROUP BY key")
def crawl_visited(spark, folder):
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=4)
    C.crawl(spark, state, _site_links(spark, folder), max_pages=None)
    return C.visited_pages(spark, state).select("key", "depth")


@query(_SITE + " SELECT key, CAST(min(depth) AS INT) AS depth FROM found GROUP BY key")
def crawl_resumed(spark, folder):
    pages = _site_links(spark, folder)
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=4)
    C.crawl(spark, state, pages, max_pages=25)
    C.crawl(spark, state, pages, max_pages=40)
    C.crawl(spark, state, pages, max_pages=None)
    return C.visited_pages(spark, state).select("key", "depth")


# Every page is reached within far fewer steps than the guard, which only keeps the check's recursion finite.
_WHOLE_SITE = _SITE.replace("w.depth < 4", "w.depth < 40").replace("n.depth < 4 AND ", "")


@query(_WHOLE_SITE + " SELECT key, CAST(min(depth) AS INT) AS depth FROM found GROUP BY key")
def crawl_all_pages(spark, folder):
    """A crawl without a bound of depth or pages: everything that links lead to."""
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=None)
    C.crawl(spark, state, _site_links(spark, folder), max_pages=None)
    return C.visited_pages(spark, state).select("key", "depth")


@query(
    _SITE + """ SELECT 'r_' || (node % 40) || '.pdf' AS filename, '.pdf' AS extension, CAST(min(depth) AS INT) AS depth, CAST(count(*) - 1 AS BIGINT) AS skipped FROM nodes GROUP BY 1"""
)
def crawl_documents(spark, folder):
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=4)
    C.crawl(spark, state, _site_links(spark, folder), max_pages=None)
    # Pages answer to two addresses with one crawl key, so each is scanned once.
    return dedup_by_name(C.found_documents(spark, state), "found_at").select("filename", "extension", "depth", "skipped")


@query(
    _WHOLE_SITE + """ SELECT 'r_' || (node % 40) || '.pdf' AS filename, CAST(min(depth) AS INT) AS depth, CAST(count(*) AS BIGINT) AS pages FROM nodes GROUP BY 1"""
)
def documents_over_batches(spark, folder):
    """Documents gathered batch after batch are those of one long scan."""
    links = _site_links(spark, folder)
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=None)
    gathered = None
    for quota in (20, 100, None):
        before = [*state.visited]
        C.crawl(spark, state, links, max_pages=quota)
        batch = C.found_documents(spark, state, state.visited[len(before):]).select("filename", "depth", "source_page")
        gathered = batch if gathered is None else gathered.unionByName(batch)
    return gathered.groupBy("filename").agg(F.min("depth").alias("depth"), F.count_distinct("source_page").alias("pages"))


_BROKEN = f"""WITH RECURSIVE {GRAPH_SQL},
walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN link_graph e ON e.src = w.node WHERE w.depth < 40 AND w.node % 7 <> 3),
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


@query(_BROKEN + " SELECT node, CAST(depth AS INT) AS depth, 'Request timed out' AS error FROM nodes WHERE node % 7 = 3")
def crawl_failures(spark, folder):
    """Pages that fail are listed with their reason, and the crawl goes on without their links."""
    pages = site_pages(spark, folder)
    number = F.regexp_extract("url", r"/p/(\d+)", 1).cast("bigint")
    pages = pages.withColumn("error", F.when(number % 7 == 3, F.lit("Request timed out")))
    state = C.start_crawl(spark, "https://site.example.com/p/0/", max_depth=None)
    C.crawl(spark, state, C.stored_links(pages), max_pages=None)
    return C.failed_pages(spark, state).select(number.alias("node"), "depth", "error")


@query(
    """WITH t AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'Error scanning ' || url || ': timed out' ELSE 'see http://x.org and ' || url || '/deeper for ' || page_id END AS error FROM pages),
f AS (SELECT DISTINCT url FROM pages WHERE contains(url, '.html') OR contains(url, '?'))
SELECT page_id, error FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE contains(t.error, f.url))"""
)
def error_theta_anti(spark, folder):
    pages = table(spark, folder, "pages")
    k = F.col("page_id")
    error = F.when(k % 2 == 0, F.concat(F.lit("Error scanning "), "url", F.lit(": timed out"))).otherwise(
        F.concat(F.lit("see http://x.org and "), "url", F.lit("/deeper for "), k.cast("string"))
    )
    fixed = pages.filter(F.contains("url", F.lit(".html")) | F.contains("url", F.lit("?"))).select("url")
    return C.remaining_errors(pages.select("page_id", error.alias("error")), fixed)


@query(
    """SELECT url, CAST(page_id % 4 AS INT) AS depth FROM pages WHERE NOT (contains(url, '.html') AND page_id % 4 = 1)"""
)
def failed_pages_after_retry(spark, folder):
    failed = table(spark, folder, "pages").select("url", (F.col("page_id") % 4).cast("int").alias("depth"))
    fixed = failed.filter(F.contains("url", F.lit(".html"))).select("url", F.lit(1).alias("depth"))
    return C.still_failed(failed, fixed)
