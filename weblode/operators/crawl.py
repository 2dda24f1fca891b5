"""Bounded breadth-first crawl as a loop of set operations, resumable from tables.

The markup is read once: ``stored_links`` turns pages into a narrow link table in buckets of the page's
address, and every level of the crawl joins that table with the pages waiting, of which only the latter move.
Addresses met so far lie in buckets of their key, so new ones find them without moving them either.  (A live crawl
fetches and prepares each level's pages instead.)  State is a few tables in the shared folder, appended to level by level; the driver
only sees their paths and counts.  A lost executor repeats its tasks, a lost driver resumes from the
written tables.

First-in-first-out order needs no global numbering: a page carries the path of positions by which it
was discovered, and paths of one depth compare in queue order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions import url as U
from weblode.operators.links import allowed_extension, extract_links, with_extension
from weblode.session import scratch_path
from weblode.sinks.bucketed import BucketedTable, bucketed

# --- reachability over an id graph ------------------------------------------------------------


def bfs_depths(edges: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """``node, depth``: least number of steps from a root, up to ``max_depth`` (all reachable when None).

    ``edges``: src, dst.  ``roots``: node.  Edges are dealt into buckets of their source once and visited nodes into
    buckets of the node, so a level moves its own nodes and the targets they reach, however large both tables are.
    Duplicate targets are combined map-side, so a node everything links to costs one row per task.
    """
    spark = edges.sparkSession
    edges = bucketed(edges.select("src", "dst"), "bfs-edges", "src")
    schema = f"node {edges.schema['dst'].dataType.simpleString()}, depth int"
    visited = BucketedTable(spark, "bfs", schema, "node", part="depth")
    visited.append(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        visited.append(next_nodes(edges, visited.read(), depth))
        if visited.read().filter(F.col("depth") == depth).isEmpty():
            break
    return visited.read()


def next_nodes(edges: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """``node, depth`` of the nodes first reached at ``depth``, given all visited before."""
    last = visited.filter(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
    reached = edges.join(last, "src").select(F.col("dst").alias("node")).distinct()
    return reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))


# --- crawl over pages -------------------------------------------------------------------------

WAITING = "key string, url string, depth int, path array<int>"
LINKS = (
    "url string, position int, link string, key string, filename string, extension string, followed boolean, error string"
)


@dataclass
class CrawlState:
    """Where a crawl stands: paths of tables, and counts.

    ``source`` is the link table of the collection being crawled; a live crawl records the link table
    of each step in ``link_tables`` instead.  ``known`` holds the keys of all pages scanned or waiting.
    """

    base: str
    start_url: str
    filter_type: str = "common"
    crawl_option: str = "follow"
    max_depth: int | None = 2
    frontier: list[str] = field(default_factory=list)
    known: BucketedTable | None = None
    depth: int = 0
    visited: list[str] = field(default_factory=list)
    link_tables: list[str] = field(default_factory=list)
    source: DataFrame | None = None
    steps: int = 0
    pages_scanned: int = 0
    pages_remaining: int = 0
    single_level: bool = True
    cancelled: bool = False
    progress: list[dict] = field(default_factory=list)

    @property
    def effective_depth(self) -> float:
        if self.crawl_option == "single":
            return 0
        return math.inf if self.max_depth is None else self.max_depth

    @property
    def has_more(self) -> bool:
        return self.pages_remaining > 0


def read_steps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All steps written below ``path`` so far; empty before the first."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def prepare_links(pages: DataFrame) -> DataFrame:
    """Link table of fetched pages (``url, html`` and optionally ``error``), one row per distinct link.

    Pages that answer to several addresses may hold ``urls``, an array, instead of ``url``: their markup is read once.
    A page with an error has one row without a link.  ``followed`` marks links to pages of the same
    site that no skip pattern excludes.
    """
    has_error = "error" in pages.columns
    good = pages.filter(F.col("error").isNull()) if has_error else pages
    links = with_extension(extract_links(good.drop("error"))).drop("kind")
    prepared = links.select(
        "url",
        "position",
        "link",
        U.crawl_key(F.col("link")).alias("key"),
        "filename",
        "extension",
        (
            U.is_page_extension(F.col("extension"))
            & ~U.is_skipped(F.col("link"))
            & U.same_site(F.col("link"), F.col("url"))
        ).alias("followed"),
        F.lit(None).cast("string").alias("error"),
    )
    if has_error:
        address = F.col("url") if "url" in pages.columns else F.explode("urls").alias("url")
        bad = pages.filter(F.col("error").isNotNull()).select(address, "error")
        prepared = prepared.unionByName(bad, allowMissingColumns=True)
    return prepared


def stored_links(pages: DataFrame) -> DataFrame:
    """:func:`prepare_links`, written once in buckets of the page's address: what to give to :func:`crawl`."""
    return bucketed(prepare_links(pages), "links", "url")


def start_crawl(
    spark: SparkSession,
    start_url: str,
    filter_type: str = "common",
    crawl_option: str = "follow",
    max_depth: int | None = 2,
) -> CrawlState:
    """A new crawl with its start page waiting; without a bound of depth if ``max_depth`` is None."""
    state = CrawlState(scratch_path(spark, "crawl"), start_url, filter_type, crawl_option, max_depth)
    seed = spark.createDataFrame([(start_url,)], "url string").select(U.normalize_url(F.col("url")).alias("url"))
    seed = seed.filter(~U.is_skipped(F.col("url"))).select(
        U.crawl_key(F.col("url")).alias("key"), "url", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path")
    )
    state.frontier = [f"{state.base}/frontier/0"]
    seed.write.parquet(state.frontier[0])
    state.known = BucketedTable(spark, "crawl-known", "key string", "key")
    state.known.append(waiting_pages(spark, state))
    _count_waiting(spark, state)
    return state


def visited_pages(spark: SparkSession, state: CrawlState, batches: list[str] | None = None) -> DataFrame:
    """``key, url, depth, path`` of the scanned pages, of all batches if none are named."""
    paths = state.visited if batches is None else batches
    return spark.read.schema(WAITING).parquet(*paths) if paths else spark.createDataFrame([], WAITING)


def _met_links(spark: SparkSession, state: CrawlState, batches: list[str] | None = None) -> DataFrame:
    """Link rows of the scanned pages, with the page's depth and discovery path."""
    here = visited_pages(spark, state, batches).select("url", "depth", "path")
    if state.source is not None:
        links = state.source
    elif state.link_tables:
        links = spark.read.schema(LINKS).parquet(*state.link_tables)
    else:
        links = spark.createDataFrame([], LINKS)
    return links.join(here, "url")


def found_documents(spark: SparkSession, state: CrawlState, batches: list[str] | None = None) -> DataFrame:
    """Every document link met, repeats included; ``found_at`` orders them by discovery.

    ``batches`` are some of ``state.visited``: the documents of those only.
    """
    wanted = _met_links(spark, state, batches).filter(allowed_extension(F.col("extension"), state.filter_type))
    return wanted.select(
        F.col("link").alias("url"),
        "filename",
        "extension",
        F.col("url").alias("source_page"),
        "depth",
        F.struct("depth", "path", "position").alias("found_at"),
    )


def failed_pages(spark: SparkSession, state: CrawlState) -> DataFrame:
    """``url, depth, error`` of scanned pages that could not be read."""
    return _met_links(spark, state).filter(F.col("error").isNotNull()).select("url", "depth", "error")


def waiting_pages(spark: SparkSession, state: CrawlState) -> DataFrame:
    return spark.read.schema(WAITING).parquet(*state.frontier)


def next_pages(links: DataFrame, batch: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """The waiting pages that a batch of scanned ones adds: followed links whose key is not known yet.

    The first spelling in queue order stands for its key.  Combined map-side, so a page that everything links to is one
    row per task before it moves.
    """
    met = links.filter("followed").join(batch.select("url", "path"), "url")
    found_at = F.struct(F.concat("path", F.array("position")).alias("path"), F.col("link").alias("url"))
    first = met.groupBy("key").agg(F.min(found_at).alias("_first"))
    fresh = first.join(known, "key", "left_anti")
    return fresh.select("key", "_first.url", F.lit(depth).alias("depth"), "_first.path")


def _count_waiting(spark: SparkSession, state: CrawlState) -> None:
    if not state.frontier:
        state.pages_remaining, state.depth, state.single_level = 0, 0, True
        return
    count, low, high = waiting_pages(spark, state).agg(F.count("*"), F.min("depth"), F.max("depth")).first()
    state.pages_remaining, state.depth, state.single_level = count, low or 0, low == high


def crawl(
    spark: SparkSession,
    state: CrawlState,
    source: DataFrame | Callable[[DataFrame], DataFrame],
    max_pages: int | None = 500,
    should_stop: Callable[[], bool] = lambda: False,
) -> CrawlState:
    """Scan up to ``max_pages`` waiting pages (None: all), level by level; call again to go on.

    ``source`` is the link table of :func:`stored_links`, or for a live crawl a function from waiting
    pages (``url``) to fetched ones (``url, html, error``).  An address without a page is scanned and
    yields nothing.  ``should_stop`` is asked between levels.  Order is kept across calls, so many
    small calls and one large call scan the same pages.
    """
    budget = max_pages
    while state.pages_remaining > 0 and (budget is None or budget > 0):
        if should_stop():
            state.cancelled = True
            break
        before = state.pages_scanned
        _step(spark, state, source, budget)
        if budget is not None:
            budget -= state.pages_scanned - before
    return state


def _step(spark: SparkSession, state: CrawlState, source, budget: int | None) -> None:
    waiting, depth = waiting_pages(spark, state), state.depth
    if state.single_level and (budget is None or budget >= state.pages_remaining):
        # The whole queue is one level and fits: it becomes the batch as it stands.
        batch, batch_paths, rest, scanned = waiting, state.frontier, [], state.pages_remaining
    else:
        level = waiting.filter(F.col("depth") == depth)
        if budget is not None:
            # The quota is a per-task top-k in queue order, bounded by the setting.
            level = level.orderBy("path").limit(budget)
        batch_path = f"{state.base}/batch/{state.steps}"
        level.write.parquet(batch_path)
        batch = spark.read.schema(WAITING).parquet(batch_path)
        rest = [f"{state.base}/rest/{state.steps}"]
        waiting.join(batch.select("key"), "key", "left_anti").write.parquet(rest[0])
        batch_paths, scanned = [batch_path], batch.count()
    state.visited += batch_paths

    if callable(source):
        table_path = f"{state.base}/links/{state.steps}"
        prepare_links(source(batch.select("url"))).write.parquet(table_path)
        state.link_tables.append(table_path)
        links = spark.read.schema(LINKS).parquet(table_path)
    else:
        links = state.source = source

    state.frontier = rest
    if depth < state.effective_depth:
        path = f"{state.base}/frontier/{state.steps + 1}"
        next_pages(links, batch, state.known.read(), depth + 1).write.parquet(path)
        state.frontier = [*rest, path]
        state.known.append(spark.read.schema(WAITING).parquet(path))
    _count_waiting(spark, state)
    state.pages_scanned += scanned
    state.steps += 1
    state.progress.append(
        {"step": state.steps, "depth": depth, "pages_scanned": state.pages_scanned, "pages_remaining": state.pages_remaining}
    )


# --- retry ------------------------------------------------------------------------------------


def retry_documents(documents: DataFrame, probes: DataFrame) -> DataFrame:
    """Discovered documents after a second probe: reachable ones take the new size and name.

    ``probes``: url, is_accessible, filename, file_size_bytes, file_size_display.
    """
    fields = ["filename", "file_size_bytes", "file_size_display"]
    second = probes.filter("is_accessible").select("url", F.struct(*fields).alias("_probe"))
    joined = documents.join(second, "url", "left")
    fixed = ~F.col("is_accessible") & F.col("_probe").isNotNull()
    changed = {name: F.when(fixed, F.col(f"_probe.{name}")).otherwise(F.col(name)) for name in fields}
    changed["is_accessible"] = F.col("is_accessible") | fixed
    changed["error_message"] = F.when(fixed, F.lit(None).cast("string")).otherwise(F.col("error_message"))
    return joined.select(*[changed.get(name, F.col(name)).alias(name) for name in documents.columns])


def still_failed(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Failed pages without exactly the (url, depth) pairs that now succeeded."""
    return failed.join(succeeded.select("url", "depth").distinct(), ["url", "depth"], "left_anti")


def remaining_errors(errors: DataFrame, fixed: DataFrame) -> DataFrame:
    """Error texts that mention none of the fixed URLs.

    ``errors``: error.  ``fixed``: url, each starting with ``http://`` or ``https://``.  "Mentions"
    means contains.  Instead of comparing every text with every URL, each place where an address
    starts in a text gives its prefixes of the lengths fixed URLs have, and those are looked up by
    equality.  The lengths are one small array; texts are read whole, and from each place no further
    than the longest fixed URL, so the work grows with the text and not with its square.
    """
    targets = fixed.select("url").distinct()
    lengths = targets.agg(F.collect_set(F.length("url"))).scalar()
    longest = targets.agg(F.max(F.length("url"))).first()[0] or 0
    # Equal texts share their verdict, and travel by their digest: a long text has many places.
    texts = errors.select("error").distinct().withColumn("_text", F.sha2("error", 256))
    places = F.regexp_extract_all(F.col("error"), F.lit(rf"(?s)(?=(https?://.{{0,{longest}}}))"), F.lit(1))
    tails = texts.select("_text", F.explode(F.array_distinct(places)).alias("_tail")).withColumn("_lengths", lengths)
    prefixes = tails.select(
        "_text",
        F.explode(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.length("_tail")), lambda n: F.substr("_tail", F.lit(1), n)
            )
        ).alias("url"),
    )
    mentioned = prefixes.join(targets, "url", "left_semi").select("_text").distinct()
    marked = errors.withColumn("_text", F.sha2("error", 256))
    return marked.join(mentioned, "_text", "left_anti").select(errors.columns)
