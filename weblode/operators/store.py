"""The versioned document store: capture, upsert, read, delete.

Plain parquet has no row updates, so every change is a function from the old snapshot to the new
one; ``sinks.tables`` writes it to a fresh path and switches over.  For stores that change often,
:func:`upsert_keyed` and :func:`delete_keyed` write only what changes, into ``sinks.keyed`` tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.text import is_missing, mime_type, type_label
from weblode.operators.ordered import changes_so_far
from weblode.schemas import BLOB, STORED_DOCUMENT
from weblode.session import materialize
from weblode.sinks.keyed import Change, KeyedTables, Layout

KEY = ["source_url", "scan_url"]


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def effective_size(size: Column, content: Column) -> Column:
    """The given size, or the content's length where it is missing or zero."""
    return F.coalesce(F.nullif(size, F.lit(0)), F.octet_length(content.cast("binary"))).cast("bigint")


def describe_captures(captures: DataFrame) -> DataFrame:
    """Add hash, type label, MIME type and size to captures holding ``content`` and ``extension``."""
    size = F.col("file_size_bytes") if "file_size_bytes" in captures.columns else F.lit(None).cast("bigint")
    return captures.withColumns({
        "content_hash": content_hash(F.col("content")),
        "file_type_label": type_label(F.col("extension")),
        "content_type": mime_type(F.col("extension")),
        "file_size_bytes": effective_size(size, F.col("content")),
    })


def version_chain(captures: DataFrame, keys: list[str], order: str, hash_column: str = "content_hash") -> DataFrame:
    """Add ``version`` and ``version_label``: the version rises when the hash differs from the capture before."""
    counted = changes_so_far(captures, keys, order, hash_column, "_changes")
    return counted.withColumn("version", (F.col("_changes") + 1).cast("int")).drop("_changes").withColumn(
        "version_label", F.concat(F.lit("v"), F.col("version").cast("string"))
    )


def document_id() -> Column:
    """Stable id of a (source_url, scan_url) pair: 24 hex digits.  A missing part differs from an empty one."""
    parts = [F.coalesce(F.col(c), F.lit("\0")) for c in ("scan_url", "source_url")]
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24)


_FIELDS = [
    "filename", "extension", "file_type_label", "source_page", "file_size_bytes", "content_type",
    "downloaded_at", "extracted_text", "text_extraction_status", "content_hash",
]


def _folded(captures: DataFrame, order: str) -> DataFrame:
    """One row per document: its last capture, the first one's hash, and how often the hash changed in between."""
    described = describe_captures(captures)
    defaults = {
        "extracted_text": F.lit(None).cast("string"),
        "text_extraction_status": F.lit("pending"),
        "downloaded_at": F.lit(None).cast("timestamp"),
    }
    described = described.withColumns({k: v for k, v in defaults.items() if k not in described.columns})
    # Bytes are not carried through the fold; the blob table keeps them under the document's blob id.
    counted = changes_so_far(described.select(*KEY, order, *_FIELDS), KEY, order, "content_hash", "_changes")
    folded = counted.groupBy(*KEY).agg(
        F.max_by(F.struct(*_FIELDS), order).alias("_new"),
        F.min_by("content_hash", order).alias("_first_hash"),
        F.max("_changes").cast("int").alias("_changes"),
    )
    return folded.withColumnsRenamed({k: f"_k_{k}" for k in KEY})


def upsert(store: DataFrame, captures: DataFrame, order: str = "seq") -> DataFrame:
    """Apply a batch of captures, in ``order``, to a store snapshot and return the new snapshot.

    Captures need ``source_url, scan_url, filename, extension, source_page, content`` and the order
    column; optional are ``extracted_text, text_extraction_status, downloaded_at, file_size_bytes``.
    Several captures of one document are folded as if applied one by one: each differing hash raises
    the version, and any change clears the summary.  A record without a hash counts as changed.
    """
    merged = store.withColumn("_exists", F.lit(True)).join(
        _folded(captures, order), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in KEY], "full_outer"
    )
    return _resolved(merged)


def upsert_keyed(tables: KeyedTables, captures: DataFrame, order: str = "seq") -> int:
    """:func:`upsert` into keyed tables ``documents`` and ``blobs``, as one commit; the commit's number.

    Only the buckets of the captured documents are read, and only the captured documents are written.
    """
    base = tables.version()
    keyed = _folded(captures, order).withColumns({k: F.col(f"_k_{k}") for k in KEY})
    folded = materialize(keyed.withColumn("_key", document_id()).drop(*KEY), "store-captures")
    named = captures.withColumn("gridfs_id", blob_id())
    known = tables.read("blobs", tables.buckets_of("blobs", named), version=base)
    buckets = tables.buckets_of("documents", folded.select(F.col("_key").alias("_id")))
    held = tables.read("documents", buckets, version=base).withColumn("_exists", F.lit(True))
    records = _resolved(folded.join(held, F.col("_key") == F.col("_id"), "left").drop("_key"))
    return tables.commit({"documents": Change(records), "blobs": Change(new_blobs(captures, known, order))}, base)


def delete_keyed(tables: KeyedTables, ids: list[str] | DataFrame) -> int:
    """Delete documents and every blob they ever had from keyed tables, as one commit; how many there were.

    ``ids`` is a short list, or a table with ``_id``.
    """
    base = tables.version()
    if isinstance(ids, list):
        doomed = tables.read("documents", keys=ids, version=base).select("_id")
    else:
        held = tables.read("documents", tables.buckets_of("documents", ids), version=base).select("_id")
        doomed = materialize(held.join(ids.select("_id"), "_id", "left_semi"), "store-doomed")
    found = doomed.count()
    if found:
        buckets = tables.buckets_of("blobs", doomed.select(F.concat("_id", F.lit("-")).alias("gridfs_id")))
        mine = tables.read("blobs", buckets, version=base).select("gridfs_id", owner_of(F.col("gridfs_id")).alias("_id"))
        blobs = mine.join(doomed, "_id", "left_semi").select("gridfs_id")
        tables.commit({"documents": Change(deleted=doomed), "blobs": Change(deleted=blobs)}, base)
    return found


def files_keyed(tables: KeyedTables, ids: list[str]) -> DataFrame:
    """``_id, filename, extension, content`` of some documents, reading their buckets of both tables only."""
    documents = tables.read("documents", keys=ids)
    blobs = [r.gridfs_id for r in documents.select("gridfs_id").filter("gridfs_id IS NOT NULL").collect()]
    return get_files(documents, tables.read("blobs", keys=blobs))


def _resolved(merged: DataFrame) -> DataFrame:
    """Records from a join of stored ones (marked ``_exists``) with folded captures."""
    merged = merged.withColumns({k: F.coalesce(k, f"_k_{k}") for k in KEY})

    arrived, existed = F.col("_new").isNotNull(), F.col("_exists").isNotNull()
    known = ~is_missing(F.col("content_hash")) & (F.col("content_hash") == F.col("_first_hash"))
    first_version = (
        F.when(~existed, F.lit(1))
        .when(known, F.coalesce(F.col("version"), F.lit(1)))
        .otherwise(F.coalesce(F.col("version"), F.lit(0)) + 1)
    )
    version = F.when(arrived, first_version + F.col("_changes")).otherwise(F.col("version"))
    differs = ~F.col("content_hash").eqNullSafe(F.col("_first_hash")) | (F.col("_changes") > 0)
    reset = arrived & (~existed | differs)

    cleared = {
        "title": None, "short_summary": None, "summary": None, "document_type": None,
        "summarized_at": None, "summary_model": None,
    }
    types = {field.name: field.dataType for field in STORED_DOCUMENT.fields}
    columns: dict[str, Column] = {
        name: F.when(arrived, F.col(f"_new.{name}")).otherwise(F.col(name)) for name in _FIELDS
    }
    columns |= {
        name: F.when(reset, F.lit(None).cast(types[name])).otherwise(F.col(name)) for name in cleared
    }
    columns["keywords"] = F.when(reset, F.array().cast("array<string>")).otherwise(F.col("keywords"))
    columns["summary_status"] = F.when(reset, F.lit("pending")).otherwise(F.col("summary_status"))
    columns["summary_error"] = F.col("summary_error")
    columns["version"] = version
    columns["version_label"] = F.when(arrived, F.concat(F.lit("v"), version.cast("string"))).otherwise(
        F.col("version_label")
    )
    columns["_id"] = F.coalesce(F.col("_id"), document_id())
    columns["gridfs_id"] = F.when(
        arrived, F.concat_ws("-", F.coalesce(F.col("_id"), document_id()), F.col("_new.content_hash"))
    ).otherwise(F.col("gridfs_id"))
    columns |= {name: F.col(name) for name in KEY}
    return merged.select(*[columns[field.name].cast(field.dataType).alias(field.name) for field in STORED_DOCUMENT])


def blob_id() -> Column:
    """Id of a capture's bytes: the document's id and the content's hash."""
    return F.concat_ws("-", document_id(), content_hash(F.col("content")))


def owner_of(gridfs_id: Column) -> Column:
    """The document a blob belongs to."""
    return F.substring_index(gridfs_id, "-", 1)


#: Tables of a store that changes in place: blobs lie in the bucket of their document.
KEYED_LAYOUTS = {
    "documents": Layout(STORED_DOCUMENT, "_id", None, ("scan_url", "filename")),
    "blobs": Layout(BLOB, "gridfs_id", "substring_index(gridfs_id, '-', 1)"),
}


def keyed_store(spark: SparkSession, root: str, buckets: int = 64) -> KeyedTables:
    """The keyed tables ``documents`` and ``blobs`` below a folder."""
    return KeyedTables(spark, root, KEYED_LAYOUTS, buckets)


def new_blobs(captures: DataFrame, known: DataFrame, order: str = "seq") -> DataFrame:
    """``gridfs_id, content`` to append to the blob table for a batch of captures.

    Bytes already stored (``known``: gridfs_id) or repeated in the batch are left out.  Which rows to
    keep is decided on ids alone; contents move once, and the blob table itself is never rewritten.
    """
    keyed = captures.withColumn("gridfs_id", blob_id())
    first = keyed.groupBy("gridfs_id").agg(F.min(order).alias(order))
    wanted = first.join(known.select("gridfs_id"), "gridfs_id", "left_anti")
    return keyed.join(wanted.select(order), order, "left_semi").select(
        "gridfs_id", F.col("content").cast("binary").alias("content")
    )


def orphaned_blobs(store: DataFrame, blobs: DataFrame) -> DataFrame:
    """Ids of blobs no stored document refers to any more."""
    return blobs.select("gridfs_id").join(store.select("gridfs_id"), "gridfs_id", "left_anti")


def get_documents(store: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Stored records by id."""
    if isinstance(ids, list):
        return store.filter(F.col("_id").isin(ids))
    return store.join(ids.select(F.col("_id").cast("string")), "_id", "left_semi")


def get_files(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """``_id, filename, extension, content``; content is null when the blob is gone.

    Blobs are first cut down to the wanted ids, which Spark does without moving them when the ids are
    few enough to broadcast.
    """
    wanted = documents.select("_id", "filename", "extension", "gridfs_id")
    hits = blobs.join(wanted.select("gridfs_id"), "gridfs_id", "left_semi")
    return wanted.join(hits, "gridfs_id", "left").drop("gridfs_id")


def delete_documents(store: DataFrame, blobs: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Snapshots of both tables without the given documents; a missing blob is no error."""
    return delete_with_blobs(store, blobs, store.filter(F.col("_id").isin(ids)))


def delete_with_blobs(store: DataFrame, blobs: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in ``doomed`` (``_id, gridfs_id``); any number of them."""
    kept = store.join(doomed.select("_id"), "_id", "left_anti")
    return kept, blobs.join(doomed.select("gridfs_id").filter("gridfs_id IS NOT NULL"), "gridfs_id", "left_anti")


def delete_matching(store: DataFrame, doomed: DataFrame) -> DataFrame:
    """The snapshot without the documents whose ``_id`` is in a table."""
    return store.join(doomed.select("_id"), "_id", "left_anti")


def document_count(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("documents"))


def select_documents(documents: DataFrame, wanted: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL is in the requested list."""
    return documents.join(wanted.select(column).distinct(), column, "left_semi")
