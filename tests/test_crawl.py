"""Crawling: order, limits, resuming, failures, retries."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weblode.operators import crawl as C
from weblode.operators.dedup import dedup_by_name

SITE = "http://s.com"


def link(target):
    return f'<a href="{target}">x</a>'


def pages_of(spark, graph, errors=None):
    rows = [(f"{SITE}{path}", "".join(link(t) for t in targets), (errors or {}).get(path)) for path, targets in graph.items()]
    return spark.createDataFrame(rows, "url string, html string, error string")


def walk(graph, start, depth_limit, quota=None):
    """First-in-first-out crawl over paths: scan order with depth."""
    queue, seen, order = deque([(start, 0)]), {start}, []
    while queue and (quota is None or len(order) < quota):
        path, depth = queue.popleft()
        order.append((path, depth))
        if depth < depth_limit:
            for target in graph.get(path, []):
                if target.startswith("/") and target not in seen:
                    seen.add(target)
                    queue.append((target, depth + 1))
    return order


def scanned(spark, state):
    rows = C.visited_pages(spark, state).orderBy("depth", "path").collect()
    return [(r.url[len(SITE):], r.depth) for r in rows]


def random_graph(seed, nodes=18):
    rng = random.Random(seed)
    return {f"/n{i}": [f"/n{rng.randrange(nodes)}" for _ in range(3)] + ["http://other.org/x"] for i in range(nodes)}


@pytest.mark.parametrize("seed", range(2))
def test_visits_in_queue_order(spark, seed):
    graph = random_graph(seed)
    state = C.start_crawl(spark, f"{SITE}/n0", max_depth=3)
    C.crawl(spark, state, C.prepare_links(pages_of(spark, graph)), max_pages=None)
    assert scanned(spark, state) == walk(graph, "/n0", 3)
    assert not state.has_more and state.pages_scanned == len(walk(graph, "/n0", 3))


def test_resuming_equals_one_run(spark):
    graph = random_graph(7)
    links = C.prepare_links(pages_of(spark, graph)).cache()
    state = C.start_crawl(spark, f"{SITE}/n0", max_depth=4)
    for quota in (2, 5, 3):
        before = state.pages_scanned
        C.crawl(spark, state, links, max_pages=quota)
        assert state.pages_scanned - before == quota and state.has_more
        assert scanned(spark, state) == walk(graph, "/n0", 4, state.pages_scanned)
    C.crawl(spark, state, links, max_pages=None)
    assert scanned(spark, state) == walk(graph, "/n0", 4)


def test_levels_leave_the_link_table_in_place(spark):
    """Only the frontier and what it reaches move: links and known keys are scanned in their buckets."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = C.stored_links(pages_of(spark, random_graph(5)))
        state = C.start_crawl(spark, f"{SITE}/n0", max_depth=None)
        C.crawl(spark, state, links, max_pages=1)
        level = C.next_pages(links, C.waiting_pages(spark, state), state.known.read(), 2)
        edges = C.bucketed(spark.range(100).selectExpr("id AS src", "id * 3 % 100 AS dst"), "edges", "src")
        visited = C.BucketedTable(spark, "seen", "node bigint, depth int", "node", part="depth")
        visited.append(spark.range(1).selectExpr("id AS node", "0 AS depth"))
        for plan, moved in ((level, 2), (C.next_nodes(edges, visited.read(), 1), 1)):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == moved, text
            # Both bucketed tables are joined as they are: no exchange stands above their scans.
            assert text.count("Bucketed: true") >= 2, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_addresses_of_one_page_share_its_markup(spark):
    """Links per address as if each had its own copy of the page, and errors too; the markup is read before addresses part."""
    page = link("a/b") + "<!-- " + link("/no") + " --><SCRIPT>" + link("/no") + "</script >" + link("/c.pdf") + '<a href="/open'
    rows = [([f"{SITE}/x/", f"{SITE}/y/z"], page, None), ([f"{SITE}/bad", f"{SITE}/bad/"], page, "gone"), ([], page, None), ([f"{SITE}/e"], None, None)]
    shared = spark.createDataFrame(rows, "urls array<string>, html string, error string")
    apart = shared.select(F.explode("urls").alias("url"), "html", "error")
    got = sorted(map(str, C.prepare_links(shared).collect()))
    assert got == sorted(map(str, C.prepare_links(apart).collect())) and len(got) == 6
    plan = C.prepare_links(shared.drop("error"))._jdf.queryExecution().executedPlan().toString()
    # Below the addresses' explode, and once.
    assert plan.count("regexp_extract_all") == 1 and plan.index("Generate explode") < plan.index("regexp_extract_all")


def test_crawl_without_a_bound_of_depth(spark):
    graph = {f"/n{i}": [f"/n{i + 1}"] for i in range(15)} | {"/n15": ["/n0"]}
    state = C.start_crawl(spark, f"{SITE}/n0", max_depth=None)
    C.crawl(spark, state, C.stored_links(pages_of(spark, graph)), max_pages=None)
    assert scanned(spark, state) == [(f"/n{i}", i) for i in range(16)] and not state.has_more


def test_single_page_and_documents(spark):
    graph = {"/n0": ["/n1", "/a.pdf", "/b/A.PDF", "/a.pdf", "/c.zip", "/feed", "/n1?replytocom=3"], "/n1": ["/d.pdf"]}
    links = C.prepare_links(pages_of(spark, graph))
    single = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0", crawl_option="single"), links)
    assert scanned(spark, single) == [("/n0", 0)]
    follow = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0", "common"), links)
    assert scanned(spark, follow) == [("/n0", 0), ("/n1", 1)]
    kept = dedup_by_name(C.found_documents(spark, follow), "found_at")
    assert {r.url[len(SITE):]: r.skipped for r in kept.collect()} == {"/a.pdf": 1, "/d.pdf": 0}


def test_tracking_variants_are_one_page(spark):
    graph = {"/n0": ["/n1?utm_source=a", "/n1/", "/n1"], "/n1?utm_source=a": ["/n2"]}
    state = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0"), C.prepare_links(pages_of(spark, graph)))
    assert [p for p, _ in scanned(spark, state)] == ["/n0", "/n1?utm_source=a", "/n2"]


def test_failures_and_missing_pages(spark):
    graph = {"/n0": ["/bad", "/gone", "/ok"], "/bad": ["/hidden"], "/ok": []}
    state = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0"), C.prepare_links(pages_of(spark, graph, {"/bad": "Request timed out"})))
    assert state.pages_scanned == 4
    assert [(r.url, r.depth, r.error) for r in C.failed_pages(spark, state).collect()] == [(f"{SITE}/bad", 1, "Request timed out")]


def test_live_source_and_stop(spark):
    graph = random_graph(3)
    table = pages_of(spark, graph)
    asked = []

    def fetch(urls):
        asked.append(urls.count())
        return table.join(urls, "url", "left_semi")

    state = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0", max_depth=2), fetch, None)
    assert scanned(spark, state) == walk(graph, "/n0", 2) and sum(asked) == state.pages_scanned
    stopped = C.crawl(spark, C.start_crawl(spark, f"{SITE}/n0"), fetch, None, should_stop=lambda: True)
    assert stopped.cancelled and stopped.pages_scanned == 0 and stopped.has_more


def test_skipped_start_page(spark):
    state = C.start_crawl(spark, f"{SITE}/feed")
    assert not state.has_more
    assert C.crawl(spark, state, C.prepare_links(pages_of(spark, {"/feed": []}))).pages_scanned == 0


def test_bfs_depths(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (9, 8)], "src bigint, dst bigint")
    roots = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.depth for r in C.bfs_depths(edges, roots, 10).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert C.bfs_depths(edges, roots, 1).count() == 3


def test_remaining_errors(spark):
    errors = ["Error scanning http://a.com/x: boom", "Error scanning http://a.com/: boom", "no address", "two http://b.com and https://c.com/y/z", "http://a.co"]
    fixed = ["http://a.com/x", "https://c.com/y", "http://zzz"]
    left = C.remaining_errors(spark.createDataFrame([(e,) for e in errors], "error string"), spark.createDataFrame([(u,) for u in fixed], "url string"))
    assert sorted(r.error for r in left.collect()) == sorted(e for e in errors if not any(u in e for u in fixed))


def test_remaining_errors_of_long_texts(spark):
    """A megabyte of addresses: no place is followed to the end of the text."""
    long = "http://a.com/x" + "y" * 20 + " "
    texts = [long * 30_000, long * 30_000 + "http://b.com/z!"]
    fixed = [f"http://b.com/{c}" for c in "xyz"] + ["http://a.com/" + "q" * 90]
    left = C.remaining_errors(spark.createDataFrame([(t,) for t in texts], "error string"), spark.createDataFrame([(u,) for u in fixed], "url string"))
    assert [len(r.error) for r in left.collect()] == [len(texts[0])]
    none = spark.createDataFrame([], "url string")
    assert C.remaining_errors(spark.createDataFrame([(t,) for t in texts], "error string"), none).count() == 2


def test_retry(spark):
    documents = spark.createDataFrame(
        [("u1", "a", None, None, False, "Timeout"), ("u2", "b", None, None, False, "HTTP 404"), ("u3", "c", 5, "5 B", True, None)],
        "url string, filename string, file_size_bytes bigint, file_size_display string, is_accessible boolean, error_message string",
    )
    probes = spark.createDataFrame(
        [("u1", True, "new", 9, "9 B"), ("u2", False, "x", None, None), ("u3", True, "other", 1, "1 B")],
        "url string, is_accessible boolean, filename string, file_size_bytes bigint, file_size_display string",
    )
    got = {r.url: (r.filename, r.file_size_bytes, r.is_accessible, r.error_message) for r in C.retry_documents(documents, probes).collect()}
    assert got == {"u1": ("new", 9, True, None), "u2": ("b", None, False, "HTTP 404"), "u3": ("c", 5, True, None)}
    failed = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "url string, depth int")
    assert sorted((r.url, r.depth) for r in C.still_failed(failed, failed.filter("url = 'p' AND depth = 2")).collect()) == [("p", 1), ("q", 1)]
    assert failed.select(F.count("*")).first()[0] == 3
