"""Queries over the document store: captures, versions, status counts, search, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.functions.text import preview
from weblode.operators import enrich as E
from weblode.operators import reports as R
from weblode.operators import search as Q
from weblode.operators import store as S
from weblode.operators.dedup import dedup_by_name, dedup_two_key, new_documents
from weblode.operators.postings import build_postings, phrase_matches, search_blocks
from weblode.plans.fixtures import CAPTURES_SQL, STORE_SQL, captures, stored_documents
from weblode.plans.registry import query
from weblode.schemas import STORED_DOCUMENT
from weblode.session import materialize, scratch_path
from weblode.sources.tables import table


def _with_store(sql: str) -> str:
    return f"WITH {STORE_SQL} {sql}"


def _chain(columns: str) -> str:
    return f"""flagged AS (SELECT *, CASE WHEN lag(content_hash) OVER w = content_hash THEN 0 ELSE 1 END AS step FROM captures
  WINDOW w AS (PARTITION BY source_url, scan_url ORDER BY seq)),
chain AS (SELECT *, CAST(sum(step) OVER (PARTITION BY source_url, scan_url ORDER BY seq) AS INT) AS version FROM flagged)
SELECT {columns} FROM chain"""


@query(
    """WITH c AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN 'XLSX' WHEN 3 THEN ' .txt ' ELSE 'zzz' END AS extension,
    CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 0 ELSE n_chars END AS given FROM documents)
SELECT doc_id, sha256(text) AS content_hash, CASE extension WHEN '.pdf' THEN 'PDF Document' WHEN '.docx' THEN 'Word Document' WHEN 'XLSX' THEN 'Excel Spreadsheet' WHEN ' .txt ' THEN 'Plain Text File' ELSE 'ZZZ File' END AS file_type_label,
  CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS content_type,
  CAST(coalesce(nullif(given, 0), octet_length(encode(text))) AS BIGINT) AS file_size_bytes FROM c"""
)
def stored_docs_hash_label(spark, folder):
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in (".pdf", ".docx", "XLSX", " .txt ", "zzz")])
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        F.element_at(kinds, (i % 5).cast("int") + 1).alias("extension"),
        F.when(i % 3 == 2, F.col("n_chars")).when(i % 3 == 1, F.lit(0)).alias("file_size_bytes"),
    )
    return S.describe_captures(rows).select("doc_id", "content_hash", "file_type_label", "content_type", "file_size_bytes")


@query(f"WITH {CAPTURES_SQL}, {_chain('seq, version, ' + repr('v') + ' || version AS version_label')}")
def version_chain(spark, folder):
    rows = captures(spark, folder).select("seq", *S.KEY, S.content_hash(F.col("content")).alias("content_hash"))
    return S.version_chain(rows, S.KEY, "seq").select("seq", "version", "version_label")


def _first_half(rows):
    """Captures of even English or German documents came first, as a batch of their own."""
    return rows.filter(F.col("content").isin("en", "de"))


@query(
    f"""WITH {CAPTURES_SQL}, reordered AS (SELECT *, (CASE WHEN content IN ('en', 'de') THEN 0 ELSE 1 END) AS batch FROM captures),
flagged AS (SELECT *, CASE WHEN lag(content_hash) OVER w = content_hash THEN 0 ELSE 1 END AS step,
    row_number() OVER (PARTITION BY source_url, scan_url ORDER BY batch DESC, seq DESC) AS back FROM reordered
  WINDOW w AS (PARTITION BY source_url, scan_url ORDER BY batch, seq)),
chain AS (SELECT *, CAST(sum(step) OVER (PARTITION BY source_url, scan_url ORDER BY batch, seq) AS INT) AS version FROM flagged)
SELECT scan_url, source_url, filename, source_page, content_hash, version, 'v' || version AS version_label, 'pending' AS summary_status,
  CAST(2 AS BIGINT) AS file_size_bytes FROM chain WHERE back = 1"""
)
def upsert_merge(spark, folder):
    rows = captures(spark, folder)
    empty = spark.createDataFrame([], STORED_DOCUMENT)
    first = S.upsert(empty, _first_half(rows))
    second = S.upsert(first, rows.filter(~F.col("content").isin("en", "de")))
    return second.select(
        "scan_url", "source_url", "filename", "source_page", "content_hash", "version", "version_label",
        "summary_status", "file_size_bytes",
    )


_CHAIN = """flagged AS (SELECT *, CASE WHEN lag(content_hash) OVER w = content_hash THEN 0 ELSE 1 END AS step,
    row_number() OVER (PARTITION BY source_url, scan_url ORDER BY seq DESC) AS back FROM given WINDOW w AS (PARTITION BY source_url, scan_url ORDER BY seq)),
chain AS (SELECT *, CAST(sum(step) OVER (PARTITION BY source_url, scan_url ORDER BY seq) AS INT) AS version FROM flagged)"""
_UPSERTED = f"""{_CHAIN}
SELECT scan_url, source_url, content_hash, version, CAST(size AS BIGINT) AS file_size_bytes FROM chain WHERE back = 1"""


def _text_captures(spark, folder):
    """Whole texts as content; documents of a source and language are captures of one address, some without one."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://d.example.com/"), "lang", (F.col("doc_id") % 50).cast("string"))).alias("source_url"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("scan_url"),
        F.lit("f.txt").alias("filename"), F.lit(".txt").alias("extension"), F.lit("p").alias("source_page"), F.col("text").alias("content"),
    )


_TEXT_CAPTURES = """given AS (SELECT doc_id AS seq, CASE WHEN doc_id % 7 <> 0 THEN 'https://d.example.com/' || lang || (doc_id % 50) END AS source_url,
  CASE WHEN doc_id % 11 <> 0 THEN source END AS scan_url, sha256(text) AS content_hash, octet_length(encode(text)) AS size FROM documents)"""


@query(f"WITH {_TEXT_CAPTURES}, {_UPSERTED}")
def upsert_null_keys(spark, folder):
    """Captures without an address or a scan are documents too."""
    found = S.upsert(spark.createDataFrame([], STORED_DOCUMENT), _text_captures(spark, folder))
    return found.select("scan_url", "source_url", "content_hash", "version", "file_size_bytes")


@query(f"WITH {_TEXT_CAPTURES}, {_UPSERTED}")
def upsert_existing_store(spark, folder):
    """Later captures arrive at a store that holds the earlier ones."""
    rows = _text_captures(spark, folder)
    middle = rows.agg(F.percentile("seq", 0.5).cast("bigint")).first()[0] or 0
    first = materialize(S.upsert(spark.createDataFrame([], STORED_DOCUMENT), rows.filter(F.col("seq") <= middle)), "store")
    found = S.upsert(first, rows.filter(F.col("seq") > middle))
    return found.select("scan_url", "source_url", "content_hash", "version", "file_size_bytes")


def _halves(rows):
    """Captures up to the middle one, and the later ones."""
    middle = rows.agg(F.percentile("seq", 0.5).cast("bigint")).first()[0] or 0
    return rows.filter(F.col("seq") <= middle), rows.filter(F.col("seq") > middle)


def _captured_store(spark, folder):
    """A keyed store that has taken all captures in two batches."""
    tables = S.keyed_store(spark, scratch_path(spark, "keyed-store"), buckets=16)
    for batch in _halves(_text_captures(spark, folder)):
        S.upsert_keyed(tables, batch)
    return tables


@query(f"WITH {_TEXT_CAPTURES}, {_UPSERTED}")
def upsert_delta(spark, folder):
    """Later captures are written as changes to the buckets they fall in, and merged when read."""
    found = _captured_store(spark, folder).read("documents")
    return found.select("scan_url", "source_url", "content_hash", "version", "file_size_bytes")


_DOOMED = "coalesce(ascii(substr(content_hash, 1, 1)) % 3 = 0, FALSE)"


@query(
    f"""WITH {_TEXT_CAPTURES}, {_CHAIN},
latest AS (SELECT scan_url, source_url, content_hash, version FROM chain WHERE back = 1),
gone AS (SELECT scan_url, source_url FROM latest WHERE {_DOOMED}),
held AS (SELECT DISTINCT scan_url, source_url, content_hash FROM given)
SELECT 'store' AS part, scan_url, source_url, content_hash, version FROM latest WHERE NOT {_DOOMED}
UNION ALL SELECT 'blobs', '', '', content_hash, count(*)::INT FROM held
WHERE NOT EXISTS (FROM gone WHERE gone.scan_url IS NOT DISTINCT FROM held.scan_url AND gone.source_url IS NOT DISTINCT FROM held.source_url)
GROUP BY content_hash"""
)
def store_compacted(spark, folder):
    """Documents go with all their blobs in one commit, and compaction leaves the same rows without any change files."""
    tables = _captured_store(spark, folder)
    doomed = tables.read("documents").filter(F.expr("ascii(substr(content_hash, 1, 1)) % 3 = 0"))
    S.delete_keyed(tables, doomed.select("_id"))
    for name in ("documents", "blobs"):
        tables.compact(name)
    blobs = tables.read("blobs").groupBy(F.substring_index("gridfs_id", "-", -1).alias("content_hash")).agg(F.count("*").cast("int").alias("version"))
    empty = [F.lit("").alias(c) for c in ("scan_url", "source_url")]
    return tables.read("documents").select(F.lit("store").alias("part"), "scan_url", "source_url", "content_hash", "version").unionByName(
        blobs.select(F.lit("blobs").alias("part"), *empty, "content_hash", "version")
    )


@query(
    f"""WITH {_TEXT_CAPTURES}, ranked AS (SELECT seq, scan_url, source_url, row_number() OVER (PARTITION BY source_url, scan_url ORDER BY seq DESC) AS back FROM given),
asked AS (SELECT seq, scan_url, source_url FROM ranked WHERE back = 1 ORDER BY seq LIMIT 5)
SELECT scan_url, source_url, text AS content FROM asked JOIN documents ON doc_id = seq"""
)
def document_files_pruned(spark, folder):
    """Contents of the five documents captured longest ago, read from their buckets."""
    tables = _captured_store(spark, folder)
    last = _text_captures(spark, folder).groupBy("scan_url", "source_url").agg(F.max("seq").alias("seq"))
    asked = last.orderBy("seq").limit(5).select(S.document_id().alias("_id"), "scan_url", "source_url")
    asked = materialize(asked, "asked")
    files = S.files_keyed(tables, [r._id for r in asked.collect()])
    return asked.join(files, "_id").select("scan_url", "source_url", F.col("content").cast("string").alias("content"))


@query(
    _with_store("""SELECT 'store' AS part, _id AS id FROM store WHERE seq % 5 <> 0 UNION ALL
SELECT 'blobs', 'blob-' || doc_id FROM documents WHERE lang <> 'fr' AND 'blob-' || doc_id NOT IN (SELECT gridfs_id FROM store WHERE seq % 5 = 0 AND gridfs_id IS NOT NULL)""")
)
def documents_and_blobs_deleted(spark, folder):
    """Deleted documents take their contents with them; a missing blob is no error."""
    store = stored_documents(spark, folder)
    blobs = table(spark, folder, "documents").filter("lang <> 'fr'").select(
        F.concat(F.lit("blob-"), F.col("doc_id").cast("string")).alias("gridfs_id"), F.col("text").alias("content")
    )
    kept, held = S.delete_with_blobs(store, blobs, store.filter("seq % 5 = 0"))
    return kept.select(F.lit("store").alias("part"), F.col("_id").alias("id")).unionByName(
        held.select(F.lit("blobs").alias("part"), F.col("gridfs_id").alias("id"))
    )


@query(
    _with_store("""SELECT s.summary_status, CAST(count(t.seq) AS BIGINT) AS documents
FROM (VALUES ('pending'), ('complete'), ('failed'), ('skipped')) s(summary_status) LEFT JOIN store t ON t.summary_status = s.summary_status GROUP BY 1""")
)
def summary_status_counts(spark, folder):
    return R.status_counts(stored_documents(spark, folder))


@query(
    _with_store("""SELECT u.scan_url, s.summary_status, CAST(count(t.seq) AS BIGINT) AS documents
FROM (SELECT DISTINCT scan_url FROM store) u, (VALUES ('pending'), ('complete'), ('failed'), ('skipped')) s(summary_status)
LEFT JOIN store t ON t.summary_status = s.summary_status AND t.scan_url = u.scan_url GROUP BY 1, 2""")
)
def scan_summary_status_counts(spark, folder):
    return R.status_counts(stored_documents(spark, folder), by_scan=True)


@query(
    _with_store("""SELECT scan_url, CAST(count(*) AS BIGINT) AS document_count, strftime(max(downloaded_at), '%Y-%m-%dT%H:%M:%S') AS latest_download FROM store GROUP BY 1""")
)
def scans_overview(spark, folder):
    return R.scans_overview(stored_documents(spark, folder))


@query(_with_store("SELECT DISTINCT scan_url, extension FROM store"))
def extensions_by_scan(spark, folder):
    return R.extensions_by_scan(stored_documents(spark, folder))


@query(_with_store("SELECT DISTINCT extension FROM store"))
def store_extensions(spark, folder):
    return R.extensions(stored_documents(spark, folder))


@query(_with_store("SELECT CAST(count(*) AS BIGINT) AS documents FROM store"))
def document_count(spark, folder):
    return S.document_count(stored_documents(spark, folder))


_PENDING = "summary_status = 'pending' AND text_extraction_status = 'complete' AND coalesce(extracted_text, '') <> ''"


@query(_with_store(f"SELECT _id, filename, extracted_text, extension FROM store WHERE {_PENDING}"))
def pending_summaries(spark, folder):
    return E.take_pending(stored_documents(spark, folder))


@query(_with_store(f"SELECT _id, filename, extension FROM store WHERE {_PENDING} ORDER BY _id LIMIT 100"))
def pending_page(spark, folder):
    return E.take_pending(stored_documents(spark, folder), 100).select("_id", "filename", "extension")


@query(
    _with_store("""SELECT _id, text_extraction_status, extracted_text = '' AS empty FROM store WHERE summary_status = 'pending'
  AND (text_extraction_status IN ('failed', 'unsupported') OR coalesce(extracted_text, '') = '')""")
)
def unsummarizable(spark, folder):
    rows = stored_documents(spark, folder).filter(E.unsummarizable())
    return rows.select("_id", "text_extraction_status", (F.col("extracted_text") == "").alias("empty"))


@query(
    _with_store("SELECT _id, filename, gridfs_id, extension FROM store WHERE summary_status IN ('pending', 'failed') AND text_extraction_status IN ('failed', 'unsupported')")
)
def reextract_candidates(spark, folder):
    return stored_documents(spark, folder).filter(E.reextract_candidate()).select("_id", "filename", "gridfs_id", "extension")


@query(_with_store("SELECT scan_url, _id, filename, summary_error, extension FROM store WHERE summary_status = 'failed'"))
def failed_summary_details(spark, folder):
    failed = stored_documents(spark, folder).filter(E.failed_summary())
    return failed.select("scan_url", "_id", "filename", "summary_error", "extension").orderBy("scan_url", "filename", "_id")


@query(
    _with_store("""SELECT _id, filename, scan_url, CASE WHEN length(extracted_text) > 300 THEN substr(extracted_text, 1, 300) || '...' ELSE extracted_text END AS extracted_text_preview,
  strftime(downloaded_at, '%Y-%m-%dT%H:%M:%S') AS downloaded FROM store WHERE extension = '.pdf' AND scan_url = (SELECT min(scan_url) FROM store) ORDER BY downloaded_at DESC, _id LIMIT 50""")
)
def search_filtered_recent(spark, folder):
    store = stored_documents(spark, folder)
    first_scan = "https://src0.example.com"
    found = Q.search(store, scan_url=first_scan, extension=".pdf", limit=50)
    return found.select(
        "_id", "filename", "scan_url", "extracted_text_preview",
        F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("downloaded"),
    )


_SEARCH = "that kw3 pdf"
_HITS = " + ".join(
    f"len(list_filter(regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w IN ('that', 'kw3', 'pdf')))"
    for f in (
        "filename", "extracted_text", "coalesce(summary, '')", "coalesce(short_summary, '')", "coalesce(title, '')", "keywords",
    )
)


@query(
    _with_store(f"""SELECT _id, filename, CAST(score AS BIGINT) AS score, CASE WHEN length(extracted_text) > 300 THEN substr(extracted_text, 1, 300) || '...' ELSE extracted_text END AS extracted_text_preview
FROM (SELECT *, {_HITS} AS score FROM store) WHERE score > 0 ORDER BY score DESC, _id LIMIT 500""")
)
def search_ranked(spark, folder):
    return Q.search(stored_documents(spark, folder), _SEARCH, limit=500).select(
        "_id", "filename", "score", "extracted_text_preview"
    )


@query(
    _with_store(f"SELECT _id, CAST(score AS BIGINT) AS score FROM (SELECT *, {_HITS} AS score FROM store) WHERE score > 0 ORDER BY score DESC, _id LIMIT 50")
)
def search_by_index(spark, folder):
    return Q.search_index(Q.build_index(stored_documents(spark, folder)), _SEARCH)


@query(
    _with_store(f"SELECT _id, CAST(score AS BIGINT) AS score FROM (SELECT *, {_HITS} AS score FROM store) WHERE score > 0 ORDER BY score DESC, _id LIMIT 50")
)
def search_topk_blocks(spark, folder):
    """The same answer from a positional index, most blocks of which are never read."""
    index = build_postings(stored_documents(spark, folder), scratch_path(spark, "postings"))
    return search_blocks(index, _SEARCH, 50).rows


_PLACES = " UNION ALL ".join(
    f"SELECT _id, {k} AS f, list_filter(regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM store"
    for k, f in enumerate(("filename", "extracted_text", "summary", "short_summary", "title", "keywords"))
)


@query(
    _with_store(f"""SELECT _id, CAST(sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))) AS INT) AS occurrences
FROM ({_PLACES}) GROUP BY _id HAVING occurrences > 0""")
)
def phrase_positions(spark, folder):
    """How often two words follow each other, whatever stands between them, from positions alone."""
    index = build_postings(stored_documents(spark, folder), scratch_path(spark, "postings"))
    return phrase_matches(index, "of the")


_FOUND = "lower(concat_ws(chr(10), filename, extracted_text, summary, short_summary, title, keywords))"
_SCORED = """SELECT _id, scan_url, CAST(score AS BIGINT) AS score, CASE WHEN length(extracted_text) > 300 THEN substr(extracted_text, 1, 300) || '...' ELSE extracted_text END AS extracted_text_preview
FROM (SELECT *, {hits} AS score FROM store) WHERE score > 0 AND {where}"""


def _hits_of(words):
    return _HITS.replace("'that', 'kw3', 'pdf'", ", ".join(f"'{w}'" for w in words))


def _indexed(spark, folder, query, **filters):
    store = stored_documents(spark, folder)
    found = Q.search_index(Q.build_index(store), query, None, store, **filters)
    return found.select("_id", "scan_url", "score", "extracted_text_preview")


@query(_with_store(_SCORED.format(hits=_hits_of(["of", "the", "kw3"]), where=f"contains({_FOUND}, 'of the')")))
def search_phrases(spark, folder):
    return _indexed(spark, folder, 'kw3 "of the"')


@query(_with_store(_SCORED.format(hits=_hits_of(["that", "kw3"]), where=f"({_hits_of(['pdf', 'die'])}) = 0")))
def search_excluded(spark, folder):
    return _indexed(spark, folder, "that kw3 -pdf -die")


@query(
    _with_store(_SCORED.format(hits=_hits_of(["that", "kw3"]), where="scan_url = 'https://src0.example.com' AND extension = '.pdf'"))
)
def search_in_scan(spark, folder):
    return _indexed(spark, folder, "that kw3", scan_url="https://src0.example.com", extension=".pdf")


@query(
    _with_store("""SELECT CASE WHEN coalesce(title, '') = '' THEN '<automated title extraction failed>' ELSE title END AS "Document Title",
  CASE WHEN coalesce(short_summary, '') = '' THEN '<automated summary extraction failed>' ELSE short_summary END AS "Short Summary",
  source_url AS "Document URL", filename AS "Filename", file_type_label AS "Document Type", version_label AS "Version" FROM store""")
)
def export_rows(spark, folder):
    return R.export_rows(stored_documents(spark, folder))


@query(
    _with_store("""SELECT _id, lower(CASE WHEN coalesce(title, '') = '' THEN filename ELSE title END) AS sort_key FROM store""")
)
def export_sort_keys(spark, folder):
    return stored_documents(spark, folder).select("_id", R.export_sort_key().alias("sort_key"))


@query(
    _with_store("""SELECT seq, source_url AS url, filename FROM store WHERE source_url IN
  (SELECT s.source_url FROM store s JOIN labels l ON l.doc_id = s.seq WHERE l.quality = 1 AND l.toxic = 1)""")
)
def selected_docs_semi(spark, folder):
    store = stored_documents(spark, folder).select("seq", F.col("source_url").alias("url"), "filename")
    labels = table(spark, folder, "labels").filter("quality = 1 AND toxic = 1")
    wanted = store.join(labels, store.seq == labels.doc_id).select("url")
    return S.select_documents(store, wanted).select("seq", "url", "filename")


@query(
    _with_store("""SELECT scan_url, CAST(count(*) AS BIGINT) AS documents_found, CAST(count(*) FILTER (WHERE NOT is_accessible) AS BIGINT) AS document_error_count,
  bool_or(NOT is_accessible) AS has_retryable_errors, CAST(sum(file_size_bytes) FILTER (WHERE file_size_bytes > 0) AS BIGINT) AS total_size_bytes,
  arg_max(filename, (file_size_bytes, -seq)) FILTER (WHERE file_size_bytes > 0) AS largest_file_name, max(file_size_bytes) FILTER (WHERE file_size_bytes > 0) AS largest_file_size,
  arg_min(filename, (file_size_bytes, seq)) FILTER (WHERE file_size_bytes > 0) AS smallest_file_name, min(file_size_bytes) FILTER (WHERE file_size_bytes > 0) AS smallest_file_size
FROM store GROUP BY 1""")
)
def scan_size_stats(spark, folder):
    return R.size_stats(stored_documents(spark, folder), ["scan_url"])


@query(
    _with_store("""SELECT t.scan_url, t.seq, t.filename, t.source_url AS url, CAST(m.n - k.n AS BIGINT) AS skipped FROM
  (SELECT scan_url, lower(filename) AS name, min(seq) AS seq, count(*) AS n FROM store GROUP BY 1, 2) m
  JOIN store t ON t.seq = m.seq JOIN (SELECT scan_url, source_url, count(*) AS n FROM store GROUP BY 1, 2) k ON k.scan_url = t.scan_url AND k.source_url = t.source_url""")
)
def dedup_by_filename(spark, folder):
    docs = stored_documents(spark, folder).select("seq", "scan_url", "filename", F.col("source_url").alias("url"))
    return dedup_by_name(docs, "seq", ["scan_url"]).select("scan_url", "seq", "filename", "url", "skipped")


@query(
    _with_store("""SELECT m.seq, t.filename, CAST(m.n - k.n AS BIGINT) AS skipped FROM
  (SELECT lower(filename) AS name, min(seq) AS seq, count(*) AS n FROM store GROUP BY 1) m
  JOIN store t ON t.seq = m.seq JOIN (SELECT source_url, count(*) AS n FROM store GROUP BY 1) k ON k.source_url = t.source_url""")
)
def dedup_across_scans(spark, folder):
    docs = stored_documents(spark, folder).select("seq", "filename", F.col("source_url").alias("url"))
    return dedup_by_name(docs).select("seq", "filename", "skipped")


def _renamed_documents(spark, folder):
    """Discovered documents whose names come from a header: file names and URLs overlap in both ways."""
    s = F.col("seq")
    return stored_documents(spark, folder).select(
        "seq",
        F.concat("scan_url", F.lit("/f/"), (s * 7 % 83).cast("string")).alias("url"),
        F.concat(F.lit("Name_"), ((s * s + F.length("source_page")) % 211).cast("string"), F.col("extension")).alias("filename"),
    )


@query(
    f"""WITH RECURSIVE {STORE_SQL}, d AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, scan_url || '/f/' || (seq * 7 % 83) AS url,
    'name_' || ((seq * seq + length(source_page)) % 211) || extension AS name FROM store),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS BIGINT) AS seq, '' AS verdict
  UNION ALL
  SELECT d.i, CASE WHEN list_contains(w.urls, d.url) OR list_contains(w.names, d.name) THEN w.urls ELSE list_append(w.urls, d.url) END,
    CASE WHEN list_contains(w.urls, d.url) OR list_contains(w.names, d.name) THEN w.names ELSE list_append(w.names, d.name) END, d.seq,
    CASE WHEN list_contains(w.urls, d.url) THEN 'repeat' WHEN list_contains(w.names, d.name) THEN 'skipped' ELSE 'kept' END
  FROM walk w JOIN d ON d.i = w.i + 1)
SELECT seq, verdict FROM walk WHERE verdict IN ('kept', 'skipped')"""
)
def dedup_two_keys(spark, folder):
    kept, skipped = dedup_two_key(_renamed_documents(spark, folder))
    return kept.select("seq", F.lit("kept").alias("verdict")).unionByName(
        skipped.select("seq", F.lit("skipped").alias("verdict"))
    )


@query(
    """WITH o AS (SELECT event_id, event_id - (SELECT min(event_id) FROM events) AS i FROM events)
SELECT event_id AS seq, CASE WHEN i % 2 = 0 THEN 'kept' ELSE 'skipped' END AS verdict FROM o"""
)
def dedup_long_chain(spark, folder):
    """One chain through all events: each shares its address with one neighbour and its file name with the other."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("seq"))
    i = F.col("seq") - events.agg(F.min("seq")).scalar()
    kept, skipped = dedup_two_key(
        events.select(
            "seq",
            F.concat(F.lit("https://h.example.com/"), F.floor((i + 1) / 2).cast("string")).alias("url"),
            F.concat(F.lit("N"), F.floor(i / 2).cast("string"), F.lit(".pdf")).alias("filename"),
        )
    )
    return kept.select("seq", F.lit("kept").alias("verdict")).unionByName(skipped.select("seq", F.lit("skipped").alias("verdict")))


@query(
    _with_store("""SELECT min(seq) AS seq, lower(filename) AS name FROM store t WHERE NOT is_accessible AND source_url NOT IN (SELECT source_url FROM store WHERE summary_status = 'complete' AND extension = '.pdf')
  AND lower(filename) NOT IN (SELECT lower(filename) FROM store WHERE summary_status = 'complete' AND extension = '.pdf') GROUP BY 2""")
)
def new_after_retry(spark, folder):
    docs = stored_documents(spark, folder).withColumnRenamed("source_url", "url")
    columns = ["seq", "url", "filename"]
    found = docs.filter(~F.col("is_accessible")).select(*columns)
    known = docs.filter("summary_status = 'complete' AND extension = '.pdf'").select(*columns)
    return new_documents(found, known).select("seq", F.lower("filename").alias("name"))


@query(
    _with_store("""SELECT s._id, s.filename, s.extension, b.content FROM store s LEFT JOIN
  (SELECT 'blob-' || doc_id AS gridfs_id, text AS content FROM documents WHERE lang <> 'fr') b ON b.gridfs_id = s.gridfs_id""")
)
def document_files(spark, folder):
    blobs = table(spark, folder, "documents").filter("lang <> 'fr'").select(
        F.concat(F.lit("blob-"), F.col("doc_id").cast("string")).alias("gridfs_id"), F.col("text").alias("content")
    )
    return S.get_files(stored_documents(spark, folder), blobs)


@query(
    _with_store("SELECT _id, filename, is_accessible FROM store WHERE is_accessible AND contains(lower(filename), '_4') OR is_accessible AND contains(lower(extension), '_4')")
)
def visible_documents(spark, folder):
    return R.visible_documents(stored_documents(spark, folder), True, "_4").select("_id", "filename", "is_accessible")


@query(
    _with_store("SELECT source_url AS url, CAST(1 AS INT) AS depth, 'document' AS kind FROM store WHERE NOT is_accessible UNION ALL SELECT url, CAST(page_id % 3 AS INT), 'page' FROM pages WHERE url LIKE 'http://%'")
)
def retry_workload(spark, folder):
    docs = stored_documents(spark, folder).select(F.col("source_url").alias("url"), F.lit(1).alias("depth"), "is_accessible")
    failed = table(spark, folder, "pages").filter(F.startswith("url", F.lit("http://"))).select(
        "url", (F.col("page_id") % 3).cast("int").alias("depth")
    )
    return R.retry_workload(docs, failed)


@query(
    _with_store("SELECT _id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM store JOIN documents ON doc_id = seq")
)
def text_preview(spark, folder):
    texts = table(spark, folder, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("_id"), "text")
    return texts.select("_id", preview(F.col("text"), 50).alias("shown"))
