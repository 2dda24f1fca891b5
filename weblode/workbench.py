"""One object for what an application does: scan, inspect, retry, store, search, export, configure.

Every method builds or runs DataFrame jobs; the object itself keeps only the open scans (request,
crawl position, table paths).  Tables live below ``root``, which all executors must share.  Network
access is injected: ``fetch`` for pages, ``probe`` for file metadata, ``size_probe`` for one-byte
range requests, ``download`` for content, each a function from URL to a raw response.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.requests import check_depth, check_path, check_url
from weblode.lookups import CRAWL_OPTIONS, FILTER_EXTENSIONS, SETTING_DEFAULTS
from weblode.operators import crawl as C
from weblode.operators import enrich as E
from weblode.operators import history as H
from weblode.operators import progress as P
from weblode.operators import reports as R
from weblode.operators import search as Q
from weblode.operators import settings as G
from weblode.operators import store as S
from weblode.operators.dedup import dedup_two_key, new_documents
from weblode.operators.naming import unique_names
from weblode.operators.ordered import numbered_by
from weblode.schemas import DOWNLOAD, HISTORY
from weblode.session import materialize
from weblode.sinks.downloads import CANCELLED, StopMarker, check_target, create_folder, save_files
from weblode.sinks.exports import export_scan
from weblode.sinks.keyed import Change, KeyedTables, Layout
from weblode.sinks.tables import SnapshotConflict, read_snapshot, snapshot_number, write_snapshot
from weblode.sources.files import extract_text, spreadsheet_profiles
from weblode.sources.http import pages_from_responses, probed_documents, probed_sizes, request_all
from weblode.sources.paced import HostPace, request_paced
from weblode.sources.services import reextract, summarize_parts
from weblode.sources.tables import health

Client = Callable[[str], dict]


@dataclass
class Scan:
    """An open scan."""

    request: dict
    state: C.CrawlState
    started: float
    ended: float | None = None
    status: str = "pending"
    documents: DataFrame | None = None
    failed: DataFrame | None = None
    cancelled: bool = False
    pages: DataFrame | None = None
    links: DataFrame | None = None


class Workbench:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fetch: Client | None = None,
        probe: Client | None = None,
        size_probe: Client | None = None,
        download: Client | None = None,
        buckets: int = 64,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.fetch, self.probe, self.size_probe, self.download = fetch, probe, size_probe, download
        self.scans: dict[str, Scan] = {}
        self.tables = S.keyed_store(spark, f"{self.root}/store", buckets)
        self.sessions = KeyedTables(spark, f"{self.root}/sessions", {"downloads": Layout(DOWNLOAD, "session_id")}, 4)

    # --- tables -------------------------------------------------------------------------------

    def store(self) -> DataFrame:
        return self.tables.read("documents")

    def blobs(self) -> DataFrame:
        return self.tables.read("blobs")

    def _save(self, changed: DataFrame) -> None:
        """Write changed records; the rest of the store stays as it is."""
        self.tables.commit({"documents": Change(changed)})

    def compact(self, least: int = 8) -> None:
        """Rewrite the buckets that have gathered changes; meant to be called now and then."""
        for name in ("documents", "blobs"):
            self.tables.compact(name, least=least)

    # --- scanning -----------------------------------------------------------------------------

    def start_scan(
        self, url: str, document_filter: str = "common", crawl_option: str = "single", max_depth: int | None = 2, scan_all_pages: bool = False
    ) -> str:
        """Validate a request and open a scan; returns its id.  ``max_depth`` None follows links to any depth."""
        if document_filter not in FILTER_EXTENSIONS or crawl_option not in CRAWL_OPTIONS:
            raise ValueError("unknown document filter or crawl option")
        limit = int(self.settings()["max_crawl_depth"])
        row = self.spark.range(1).select(
            check_url(F.lit(url)).alias("r"), check_depth(F.lit(1 if max_depth is None else max_depth), F.lit(limit)).alias("d")
        ).first()
        if row.r.error or row.d:
            raise ValueError(row.r.error or row.d)
        request = {
            "url": row.r.url, "document_filter": document_filter, "crawl_option": crawl_option, "max_depth": max_depth,
            "scan_all_pages": scan_all_pages,
        }
        state = C.start_crawl(self.spark, row.r.url, document_filter, crawl_option, max_depth)
        scan_id = str(uuid.uuid4())
        self.scans[scan_id] = Scan(request, state, time.time())
        return scan_id

    def run_scan(self, scan_id: str, pages: DataFrame | None = None) -> DataFrame:
        """Scan the next batch (all pages if asked for) and return the documents found so far.

        ``pages`` (url, html, error) is a fetched collection; without it pages are fetched live.
        Call again while :meth:`summary` reports more pages: with the same collection, or with none, the scan goes on
        with the links already read from it.
        """
        scan = self._scan(scan_id)
        scan.status, scan.cancelled = "scanning", False
        quota = None if scan.request["scan_all_pages"] else int(self.settings()["max_pages_per_scan"])
        if pages is not None and pages is not scan.pages:
            scan.pages, scan.links = pages, C.stored_links(pages)
        source = self._fetch_pages if scan.links is None else scan.links
        C.crawl(self.spark, scan.state, source, quota, lambda: scan.cancelled)
        scan.documents = self._documents(scan)
        scan.failed = materialize(C.failed_pages(self.spark, scan.state), "failed")
        scan.status, scan.ended = "complete", time.time()
        self._remember(scan_id, scan)
        return scan.documents

    def _fetch_pages(self, urls: DataFrame) -> DataFrame:
        settings = self.settings()
        # The pace of a host holds over all scans that share these tables.
        pace = HostPace(self.spark, f"{self.root}/pace", float(settings["requests_per_second"]))
        responses = materialize(request_paced(urls, self.fetch, pace, int(settings["max_concurrent_requests"])), "responses")
        return pages_from_responses(responses).withColumnRenamed("warning", "error")

    def _documents(self, scan: Scan) -> DataFrame:
        found = C.found_documents(self.spark, scan.state)
        # One probe per address, at its first appearance.
        first = found.groupBy("url").agg(F.min_by(F.struct("source_page", "depth"), "found_at").alias("at"), F.min("found_at").alias("found_at"))
        links = first.select("url", "at.source_page", "at.depth", "found_at")
        if self.probe is None:
            responses = links.select("url", F.lit(200).alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("content_length", "content_disposition", "failure", "failure_text", "body")])
        else:
            responses = materialize(request_all(links, self.probe, int(self.settings()["max_concurrent_requests"])), "probes")
        probed = probed_documents(links, responses).join(links.select("url", "found_at"), "url")
        kept, _ = dedup_two_key(probed, "found_at")
        return materialize(kept, "documents")

    def progress(self, scan_id: str) -> Iterator[str]:
        """The scan's steps as JSON events."""
        for step in self._scan(scan_id).state.progress:
            yield json.dumps({"event": "progress", **step})

    def results(self, scan_id: str) -> DataFrame:
        scan = self._scan(scan_id)
        if scan.documents is None:
            raise ValueError("Results not yet available")
        return scan.documents

    def summary(self, scan_id: str) -> dict:
        """The 13-field summary of a scan."""
        scan = self._scan(scan_id)
        request = scan.request
        requests = self.spark.createDataFrame(
            [(scan_id, request["url"], request["crawl_option"], request["max_depth"], request["document_filter"], request["scan_all_pages"], scan.started, scan.ended)],
            "session_id string, url string, crawl_option string, max_depth int, document_type_filter string, scan_all_pages boolean, start_time double, end_time double",
        )
        counts = self._counts(scan)
        results = self.spark.createDataFrame(
            [(scan_id, scan.state.pages_scanned, scan.state.pages_remaining, *counts)] if scan.documents is not None else [],
            "session_id string, pages_scanned bigint, pages_remaining bigint, documents_found bigint, document_error_count bigint, failed_pages bigint, scan_error_count bigint",
        )
        return R.scan_summary(requests, results).drop("session_id").first().asDict()

    def _counts(self, scan: Scan) -> tuple[int, int, int, int]:
        if scan.documents is None:
            return 0, 0, 0, 0
        found, bad = scan.documents.agg(F.count("*"), F.count_if(~F.col("is_accessible"))).first()
        failed = scan.failed.count()
        return found, bad, failed, failed

    def _remember(self, scan_id: str, scan: Scan) -> None:
        """Add the scan to the history; if someone else did so meanwhile, count its id again."""
        while True:
            try:
                return self._append_history(scan, snapshot_number(self.spark, f"{self.root}/history"))
            except SnapshotConflict:
                continue

    def _append_history(self, scan: Scan, base: int) -> None:
        old = self.history_table()
        new_id = (old.agg(F.max("id")).first()[0] or 0) + 1
        r = scan.request
        scans = self.spark.createDataFrame(
            [(new_id, r["url"], r["crawl_option"], r["max_depth"], r["scan_all_pages"], r["document_filter"], scan.state.pages_scanned, self._counts(scan)[3], scan.started, scan.ended)],
            "id bigint, url string, crawl_option string, max_depth int, scan_all_pages boolean, document_filter string, pages_scanned bigint, scan_error_count bigint, start_time double, end_time double",
        ).withColumns({"completed_at": F.timestamp_seconds("end_time"), "started_at": F.timestamp_seconds("end_time")})
        documents = scan.documents.select(F.lit(new_id).cast("bigint").alias("id"), "filename", "file_size_bytes", "is_accessible", F.xxhash64("url").alias("seq"))
        rows = H.history_rows(scans, documents)
        write_snapshot(H.append(old, rows, int(self.settings()["scan_history_limit"])), f"{self.root}/history", base=base)

    def cancel(self, scan_id: str) -> None:
        """Stop before the next level; what was found stays."""
        self._scan(scan_id).cancelled = True

    def close(self, scan_id: str) -> None:
        self.scans.pop(scan_id, None)

    def retry(self, scan_id: str) -> dict:
        """Probe unreachable documents and failed pages again; merge what now works."""
        scan = self._scan(scan_id)
        documents, failed = self.results(scan_id), scan.failed
        before = documents.filter(~F.col("is_accessible")).count()
        pages = failed.count()
        if not before and not pages:
            raise ValueError("No errors to retry")
        limit = int(self.settings()["max_concurrent_requests"])
        if before:
            again = documents.filter(~F.col("is_accessible"))
            links = again.select("url", "source_page", "depth")
            responses = materialize(request_all(links, self.probe, limit), "retry-probes")
            documents = C.retry_documents(documents, probed_documents(links, responses))
        fixed_pages = new = 0
        if pages:
            fetched = self._fetch_pages(failed.select("url"))
            good = fetched.filter(F.col("error").isNull()).join(failed.select("url", "depth"), "url")
            links = materialize(C.prepare_links(good.select("url", "html")), "retry-links")
            here = links.join(failed.select("url", "depth"), "url").filter(C.allowed_extension(F.col("extension"), scan.request["document_filter"]))
            met = here.groupBy("link").agg(F.min_by(F.struct(F.col("url").alias("source_page"), "depth"), F.struct("url", "position")).alias("at"))
            met = met.select(F.col("link").alias("url"), "at.source_page", "at.depth")
            responses = materialize(request_all(met, self.probe, limit), "retry-probes")
            fresh = new_documents(probed_documents(met, responses).withColumn("seq", F.struct("source_page", "url")), documents)
            fresh = materialize(fresh.drop("seq"), "retry-documents")
            new = fresh.count()
            documents = documents.unionByName(fresh, allowMissingColumns=True)
            scan.failed = materialize(C.still_failed(failed, good), "failed")
            fixed_pages = pages - scan.failed.count()
        scan.documents = materialize(documents, "documents")
        found, bad, still, _ = self._counts(scan)
        return {
            "docs_fixed": before - (bad - (0 if not new else fresh.filter(~F.col("is_accessible")).count())),
            "pages_fixed": fixed_pages, "new_docs_found": new,
            "remaining_scan_errors": still, "remaining_doc_errors": bad, "total_documents": found,
        }

    def calculate_sizes(self, scan_id: str, urls: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
        """(progress rows, totals) of a size calculation for the given files."""
        self._scan(scan_id)
        wanted = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        sizes = materialize(probed_sizes(request_all(wanted, self.size_probe)), "sizes")
        # Any fixed order serves for progress; ranks of the address hash are one.
        ordered = sizes.withColumn("seq", F.shiftrightunsigned(F.xxhash64("url"), 10))
        return P.size_progress(ordered), R.size_totals(sizes)

    def _scan(self, scan_id: str) -> Scan:
        if scan_id not in self.scans:
            raise KeyError("Session not found")
        return self.scans[scan_id]

    # --- store --------------------------------------------------------------------------------

    def store_documents(self, scan_id: str, urls: list[str] | DataFrame) -> dict:
        """Download the selected documents of a scan into the store."""
        scan = self._scan(scan_id)
        wanted = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        selected = S.select_documents(self.results(scan_id), wanted)
        responses = materialize(request_all(selected, self.download, 5), "downloads")
        good = responses.filter((F.col("status") == 200) & F.col("failure").isNull()).select("url", F.coalesce("body", F.lit(b"")).alias("content"))
        total, completed = selected.count(), good.count()
        if not total:
            raise ValueError("No valid documents selected")
        captures = selected.join(good, "url").select(
            F.monotonically_increasing_id().alias("seq"), F.col("url").alias("source_url"), F.lit(scan.request["url"]).alias("scan_url"),
            "filename", "extension", "source_page", "content", F.lit(time.time()).cast("timestamp").alias("downloaded_at"),
        )
        S.upsert_keyed(self.tables, materialize(extract_text(captures), "captures"))
        return {
            "total_files": total, "files_completed": completed, "files_failed": total - completed,
            "message": f"Stored {completed} files, {total - completed} failed",
        }

    def document(self, document_id: str) -> DataFrame:
        return self.tables.read("documents", keys=[document_id])

    def file(self, document_id: str) -> DataFrame:
        return S.files_keyed(self.tables, [document_id])

    def delete_document(self, document_id: str) -> bool:
        """Remove a document and every blob it ever had, in one commit."""
        return S.delete_keyed(self.tables, [document_id]) > 0

    def store_status(self) -> dict:
        """Whether the store answers, and how many documents it holds."""
        return health(self.store)

    # --- downloads to a folder ----------------------------------------------------------------

    def check_folder(self, path: str, required_bytes: int = 0) -> dict:
        """Whether a folder can take a download of that size: ``valid, code, message, path``."""
        seen = check_target(path, required_bytes)
        kinds = "path string, exists boolean, is_dir boolean, writable boolean, free bigint, required bigint"
        row = self.spark.createDataFrame([tuple(seen.values())], kinds)
        judged = row.select(check_path(*[F.col(c) for c in ("exists", "is_dir", "writable", "path", "free", "required")]).alias("r"))
        return judged.first().r.asDict() | {"path": seen["path"]}

    def make_folder(self, path: str) -> str:
        """Create a folder for downloads; its absolute path."""
        if not path:
            raise ValueError("Path cannot be empty")
        ready, place = create_folder(path)
        if not ready:
            raise ValueError(place)
        return place

    def download_to_folder(self, scan_id: str, urls: list[str] | DataFrame, folder: str, open_stream, session_id: str | None = None) -> tuple[dict, DataFrame]:
        """Save documents of a scan under unique names, numbered in the order they were found; counts, and a row per file.

        ``open_stream(url)`` yields the file's bytes in pieces.  Names taken in the folder are passed over.  The
        download is a session: a row of :meth:`downloads`, which :meth:`cancel_download` stops while it runs.  A scan
        that was cancelled starts no files.
        """
        scan = self._scan(scan_id)
        ready, place = create_folder(folder)
        if not ready:
            raise ValueError(place)
        session = session_id or str(uuid.uuid4())
        marker = self._stop_marker(session)
        wanted = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        found_at = F.col("found_at") if "found_at" in scan.documents.columns else F.lit(None)
        selected = S.select_documents(self.results(scan_id), wanted)
        ordered = numbered_by(selected, [found_at.asc_nulls_last(), F.col("url")])
        taken = self.spark.createDataFrame([(n,) for n in sorted(os.listdir(place))], "saved_name string")
        named = materialize(unique_names(ordered.select("url", "filename", "seq"), taken), "download-names")
        total = named.count()
        self._note_download(session, scan_id, place, "running", total)
        if scan.cancelled:
            marker()
        # The tag lets a scheduler stop the job itself; the marker stops it file by file, with everything done listed.
        self.spark.addTag(f"download-{session}")
        try:
            saved = materialize(save_files(named, place, open_stream, marker.seen), "downloads")
        finally:
            self.spark.removeTag(f"download-{session}")
        counts = saved.agg(F.count_if("succeeded"), F.sum("bytes"), F.count_if(F.col("message") == CANCELLED)).first()
        done = {"total_files": total, "files_completed": counts[0], "files_failed": total - counts[0], "bytes": counts[1] or 0}
        self._note_download(session, scan_id, place, "cancelled" if counts[2] else "complete", total, counts[0])
        return done, saved

    def _stop_marker(self, session: str) -> StopMarker:
        return StopMarker(f"{self.root}/stops/{session}")

    def _note_download(self, session: str, scan_id: str, folder: str, status: str, total: int, completed: int = 0) -> None:
        row = self.spark.createDataFrame([(session, scan_id, folder, status, total, completed, total - completed)], DOWNLOAD)
        self.sessions.commit({"downloads": Change(row)})

    def downloads(self) -> DataFrame:
        """Download sessions: folder, status, and counts."""
        return self.sessions.read("downloads")

    def cancel_download(self, session_id: str, at_once: bool = False) -> None:
        """Stop a running download before its next file or piece; with ``at_once`` its Spark job as well."""
        self._stop_marker(session_id)()
        if at_once:
            self.spark.interruptTag(f"download-{session_id}")

    def search(self, query: str = "", scan_url: str = "", extension: str = "", limit: int | None = 50) -> DataFrame:
        return Q.search(self.store(), query, scan_url, extension, limit)

    def stored_scans(self) -> DataFrame:
        return R.scans_overview(self.store())

    def extensions(self, scan_url: str = "") -> DataFrame:
        return R.extensions(self.store(), scan_url)

    def status_counts(self, scan_url: str = "") -> dict:
        store = self.store() if not scan_url else self.store().filter(F.col("scan_url") == scan_url)
        return {r.summary_status: r.documents for r in R.status_counts(store).collect()}

    def failed_details(self, scan_url: str) -> DataFrame:
        return R.failed_details(self.store(), scan_url)

    def export_csv(self, scan_url: str, path: str) -> None:
        export_scan(self.store(), scan_url, path)

    # --- enrichment ---------------------------------------------------------------------------

    def reset_summaries(self, scan_url: str | None = None, failed_only: bool = True) -> int:
        """Return summaries to pending: failed ones, or all of a scan; how many changed."""
        store = self.store()
        update = E.reset_failed(scan_url) if failed_only else E.reset_scan(scan_url)
        changed = store.agg(update.modified(store)).first()[0]
        if changed:
            self._save(update.apply(store.filter(update.condition)))
        return changed

    def enrich(self, post: Callable[[str], dict], api_url: str, model: str, fast=None, ocr=None, pause=time.sleep) -> dict:
        """Recover texts, mark what cannot be summarized, summarize the rest; counts of the outcome."""
        store = self.store()
        candidates = S.get_files(store.filter(E.reextract_candidate()), self.blobs())
        attempts = materialize(reextract(candidates, fast, ocr), "attempts")
        self._save(E.apply_reextraction(store.join(attempts.select("_id"), "_id", "left_semi"), attempts))
        skipped = 0
        for mark in (E.mark_unsummarizable(), E.mark_blank()):
            store = self.store()
            skipped += store.agg(mark.modified(store)).first()[0]
            self._save(mark.apply(store.filter(mark.condition)))
        store = self.store()
        pending = E.take_pending(store)
        sheets = store.join(pending.select("_id"), "_id", "left_semi").filter(E.wants_sheet_prompt(F.col("extension")))
        profiles = spreadsheet_profiles(S.get_files(sheets, self.blobs()), "_id")
        prompts = materialize(E.prompts(pending, profiles), "prompts")
        replies = summarize_parts(prompts, post, api_url, model, pause)
        answered = store.join(replies.select("_id"), "_id", "left_semi")
        self._save(E.write_summaries(answered, replies, model, F.lit(time.time()).cast("timestamp")))
        done = replies.agg(F.count("*"), F.count_if(F.col("error").isNull())).first()
        return {"processed": done[0], "succeeded": done[1], "failed": done[0] - done[1], "skipped": skipped}

    # --- history and settings -----------------------------------------------------------------

    def history_table(self) -> DataFrame:
        return read_snapshot(self.spark, f"{self.root}/history", HISTORY)

    def history(self, limit: int | None = None) -> DataFrame:
        return H.newest(self.history_table(), int(self.settings()["scan_history_limit"]) if limit is None else limit)

    def clear_history(self) -> None:
        write_snapshot(self.spark.createDataFrame([], HISTORY), f"{self.root}/history")

    def _stored_settings(self) -> DataFrame:
        return read_snapshot(self.spark, f"{self.root}/settings", "key string, value string")

    def settings(self, masked: bool = True) -> dict:
        """All settings; the table has one row per known key."""
        current = G.effective(G.defaults(self.spark), self._stored_settings())
        return {r.key: json.loads(r.value) for r in (G.masked(current) if masked else current).collect()}

    def update_settings(self, **updates) -> dict:
        current = G.effective(G.defaults(self.spark), self._stored_settings())
        rows = [(k, G.encode(v)) for k, v in updates.items()]
        changed = G.apply_updates(current, self.spark.createDataFrame(rows, "key string, value string"))
        write_snapshot(changed, f"{self.root}/settings")
        return self.settings()

    def reset_settings(self) -> dict:
        write_snapshot(G.defaults(self.spark), f"{self.root}/settings")
        assert set(self.settings()) == set(SETTING_DEFAULTS)
        return self.settings()
