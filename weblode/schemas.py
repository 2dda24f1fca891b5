"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
}

def _struct(columns: str) -> T.StructType:
    """A struct from ``name type [not null], ...`` that needs no running session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)

DISCOVERED = _struct(
    "url string not null, filename string not null, extension string not null, file_size_bytes bigint,"
    " file_size_display string, source_page string not null, depth int not null,"
    " is_accessible boolean not null, error_message string"
)

STORED_DOCUMENT = _struct(
    "_id string, filename string, extension string, file_type_label string, source_url string,"
    " source_page string, scan_url string, file_size_bytes bigint, content_type string, gridfs_id string,"
    " downloaded_at timestamp, extracted_text string, text_extraction_status string, content_hash string,"
    " version int, version_label string, title string, short_summary string, summary string,"
    " keywords array<string>, document_type string, summary_status string, summary_error string,"
    " summarized_at timestamp, summary_model string"
)

BLOB = _struct("gridfs_id string, content binary")

#: The earliest time, in epoch milliseconds, at which a host may be asked next.
HOST_SLOTS = _struct("host string, next_ms bigint")

DOWNLOAD = _struct(
    "session_id string, scan_id string, folder string, status string, total_files bigint, files_completed bigint,"
    " files_failed bigint"
)

#: A paid call, its state (waiting, done or failed) and the parts of its last reply.
CALL = _struct(
    "call_key string, _id string, request string, state string, attempts int, status int, request_id string,"
    " retry_after string, remaining string, body string, failure string"
)

HISTORY = _struct(
    "id bigint, url string, crawl_option string, max_depth int, scan_mode string, document_filter string,"
    " pages_scanned bigint, documents_found bigint, scan_error_count bigint, document_error_count bigint,"
    " duration_seconds double, total_size_bytes bigint, largest_file_name string, largest_file_size bigint,"
    " smallest_file_name string, smallest_file_size bigint, started_at timestamp, completed_at timestamp"
)
