"""Summary and extraction status: filters, transitions and the enrichment batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.text import build_prompt, is_blank, is_missing, strip, text_parts
from weblode.lookups import NO_TEXT_ERROR, SPREADSHEET_EXTENSIONS, UNSUMMARIZABLE_ERROR

# --- filters ----------------------------------------------------------------------------------


def unextracted() -> Column:
    return F.col("text_extraction_status").isin("failed", "unsupported")


def pending_summary() -> Column:
    """Extracted, non-empty, waiting for a summary."""
    return (
        (F.col("summary_status") == "pending")
        & (F.col("text_extraction_status") == "complete")
        & ~is_missing(F.col("extracted_text"))
    )


def unsummarizable() -> Column:
    """Waiting for a summary that cannot be made.  Not the complement of :func:`pending_summary`."""
    return (F.col("summary_status") == "pending") & (unextracted() | is_missing(F.col("extracted_text")))


def reextract_candidate() -> Column:
    return F.col("summary_status").isin("pending", "failed") & unextracted()


def failed_summary(scan_url: str | None = None) -> Column:
    failed = F.col("summary_status") == "failed"
    return failed if scan_url is None else failed & (F.col("scan_url") == scan_url)


def take_pending(store: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents to summarize: id, file name, text, extension; the first ``limit`` by id if given."""
    rows = store.filter(pending_summary()).select("_id", "filename", "extracted_text", "extension")
    return rows if limit is None else rows.orderBy("_id").limit(limit)


# --- transitions ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Update:
    """Assignments for the rows a condition selects."""

    condition: Column
    assignments: dict[str, Column] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        changed = {
            name: F.when(self.condition, value.cast(df.schema[name].dataType)).otherwise(F.col(name))
            for name, value in self.assignments.items()
        }
        # One select: every condition sees the old row.
        return df.select(*[changed.get(name, F.col(name)).alias(name) for name in df.columns])

    def modified(self, df: DataFrame) -> Column:
        """Aggregate: how many rows really change."""
        differs = F.lit(False)
        for name, value in self.assignments.items():
            differs = differs | ~F.col(name).eqNullSafe(value.cast(df.schema[name].dataType))
        return F.count_if(self.condition & differs)


def _null() -> Column:
    return F.lit(None)


def mark_unsummarizable() -> Update:
    return Update(
        unsummarizable(), {"summary_status": F.lit("failed"), "summary_error": F.lit(UNSUMMARIZABLE_ERROR)}
    )


def mark_blank() -> Update:
    """Pending documents whose text is only whitespace."""
    return Update(
        pending_summary() & is_blank(F.col("extracted_text")),
        {"summary_status": F.lit("failed"), "summary_error": F.lit(NO_TEXT_ERROR)},
    )


def reset_failed(scan_url: str | None = None) -> Update:
    return Update(failed_summary(scan_url), {"summary_status": F.lit("pending"), "summary_error": _null()})


def reset_scan(scan_url: str) -> Update:
    """Recreate all summaries of a scan."""
    done = (F.col("scan_url") == scan_url) & F.col("summary_status").isin("complete", "failed")
    cleared = ["title", "short_summary", "summary", "document_type", "summary_error", "summarized_at", "summary_model"]
    return Update(
        done,
        {name: _null() for name in cleared}
        | {"keywords": F.array().cast("array<string>"), "summary_status": F.lit("pending")},
    )


def write_summaries(store: DataFrame, replies: DataFrame, model: str, as_of: Column) -> DataFrame:
    """Apply replies (``_id`` plus the reply fields) by key: a summary completes a document, an error fails it."""
    mine = replies.select(
        "_id",
        F.struct("title", "short_summary", "summary", "keywords", "document_type", "error").alias("_reply"),
    )
    joined = store.join(mine, "_id", "left")
    answered = F.col("_reply").isNotNull()
    good = answered & F.col("_reply.error").isNull()
    columns = {name: F.col(name) for name in store.columns}
    for name in ("title", "short_summary", "summary", "keywords", "document_type"):
        columns[name] = F.when(good, F.col(f"_reply.{name}")).otherwise(F.col(name))
    columns["summary_status"] = (
        F.when(good, F.lit("complete")).when(answered, F.lit("failed")).otherwise(F.col("summary_status"))
    )
    columns["summary_error"] = (
        F.when(good, _null().cast("string"))
        .when(answered, F.col("_reply.error"))
        .otherwise(F.col("summary_error"))
    )
    columns["summarized_at"] = F.when(good, as_of.cast("timestamp")).otherwise(F.col("summarized_at"))
    columns["summary_model"] = F.when(good, F.lit(model)).otherwise(F.col("summary_model"))
    return joined.select(*[column.alias(name) for name, column in columns.items()])


# --- re-extraction ----------------------------------------------------------------------------


def reextraction_outcome() -> Column:
    """Which stage gave the text: ``standard``, ``fast`` or ``ocr`` (PDF only), else ``failed``.

    Reads ``extension``, ``standard_text``, ``fast_text``, ``ocr_text`` and ``has_blob``.
    """
    pdf = F.lower("extension") == ".pdf"
    return (
        F.when(~F.col("has_blob"), F.lit("failed"))
        .when(~is_blank(F.col("standard_text")), F.lit("standard"))
        .when(pdf & ~is_missing(F.col("fast_text")), F.when(is_blank(F.col("fast_text")), F.lit("fast_blank")).otherwise(F.lit("fast")))
        .when(pdf & ~is_missing(F.col("ocr_text")), F.when(is_blank(F.col("ocr_text")), F.lit("ocr_blank")).otherwise(F.lit("ocr")))
        .otherwise(F.lit("failed"))
    )


def reextraction_counts(attempts: DataFrame) -> DataFrame:
    """One row: ``total, succeeded, fast, ocr, failed`` and the PDF split of the attempts."""
    outcome = F.col("outcome")
    return attempts.withColumn("outcome", reextraction_outcome()).agg(
        F.count("*").alias("total"),
        F.count_if(outcome.isin("standard", "fast", "ocr")).alias("succeeded"),
        F.count_if(outcome.isin("fast", "fast_blank")).alias("fast"),
        F.count_if(outcome.isin("ocr", "ocr_blank")).alias("ocr"),
        F.count_if(outcome.isin("failed", "fast_blank", "ocr_blank")).alias("failed"),
        F.count_if(F.lower("extension") == ".pdf").alias("pdf"),
        F.count_if(F.lower("extension") != ".pdf").alias("other"),
    )


def apply_reextraction(store: DataFrame, attempts: DataFrame) -> DataFrame:
    """Store the recovered texts: extraction complete, summary pending again."""
    outcome = reextraction_outcome()
    text = (
        F.when(outcome == "standard", F.col("standard_text"))
        .when(outcome == "fast", F.col("fast_text"))
        .when(outcome == "ocr", F.col("ocr_text"))
    )
    fixed = attempts.select("_id", strip(text).alias("_text")).filter(F.col("_text").isNotNull())
    joined = store.join(fixed, "_id", "left")
    found = F.col("_text").isNotNull()
    return joined.withColumns({
        "extracted_text": F.coalesce("_text", "extracted_text"),
        "text_extraction_status": F.when(found, F.lit("complete")).otherwise(F.col("text_extraction_status")),
        "summary_status": F.when(found, F.lit("pending")).otherwise(F.col("summary_status")),
        "summary_error": F.when(found, F.lit(None)).otherwise(F.col("summary_error")),
    }).select(*store.columns)


# --- prompts and counters ---------------------------------------------------------------------


def wants_sheet_prompt(extension: Column) -> Column:
    return F.lower(extension).isin(SPREADSHEET_EXTENSIONS)


#: Characters of a document that one prompt carries, by default.
PROMPT_CHARS = 12_000


def prompts(pending: DataFrame, profiles: DataFrame | None = None, size: int = PROMPT_CHARS) -> DataFrame:
    """``_id, filename, kind, part, parts, prompt`` for pending documents; every character is in some part.

    Tabular files use their profile (``_id, profile``) where there is one, all others their text.
    """
    rows = pending
    if profiles is not None:
        rows = rows.join(profiles.select("_id", "profile"), "_id", "left")
        sheet = wants_sheet_prompt(F.col("extension")) & ~is_missing(F.col("profile"))
        body, kind = F.when(sheet, F.col("profile")).otherwise(F.col("extracted_text")), F.when(sheet, F.lit("sheet"))
    else:
        body, kind = F.col("extracted_text"), F.lit(None)
    return prompt_rows(rows.select("_id", "filename", F.coalesce(kind, F.lit("text")).alias("kind"), body.alias("body")), size)


def prompt_rows(bodies: DataFrame, size: int | None = PROMPT_CHARS) -> DataFrame:
    """One prompt per part of each ``_id, filename, kind, body``; ``size`` None leaves bodies whole."""
    cut = text_parts(F.col("body"), size) if size else F.array("body")
    rows = bodies.withColumn("_cut", cut).withColumn("parts", F.size("_cut"))
    rows = rows.select("_id", "filename", "kind", "parts", F.posexplode("_cut").alias("_at", "_text"))
    part = F.col("_at") + 1
    return rows.select(
        "_id", "filename", "kind", part.alias("part"), "parts",
        build_prompt(F.col("filename"), F.col("_text"), part, F.col("parts")).alias("prompt"),
    )


def enrichment_counts(outcomes: DataFrame) -> DataFrame:
    """``processed, succeeded, failed, skipped`` from rows with ``attempted`` and ``error``."""
    attempted = F.col("attempted")
    return outcomes.agg(
        F.count_if(attempted).alias("processed"),
        F.count_if(attempted & F.col("error").isNull()).alias("succeeded"),
        F.count_if(attempted & F.col("error").isNotNull()).alias("failed"),
        F.count_if(~attempted).alias("skipped"),
    )


# --- status from an event log -----------------------------------------------------------------


def status_from_events(events: DataFrame, key: str, order: str, event: str = "event") -> DataFrame:
    """Current ``summary_status`` per document from its event log.

    ``stored`` and ``reset`` make a document pending, ``summarized`` completes it, ``failed`` fails
    it, and ``extracted`` returns a failed one to pending.  Only ``extracted`` depends on the state
    before it, so the fold is two maxima: the last other event, and whether an extraction followed.
    The last event is found as one number, its position with its kind in the two lowest bits: plain
    long maxima run as hash aggregation and combine map-side, however many events a document has.
    """
    other = F.col(event) != "extracted"
    position = F.col(order).cast("bigint")
    kind = F.when(F.col(event) == "summarized", 1).when(F.col(event) == "failed", 2).otherwise(0)
    folded = events.groupBy(key).agg(
        F.max(F.when(other, position * 4 + kind)).alias("_last"),
        F.max(F.when(~other, position)).alias("_extracted_at"),
        F.count("*").alias("events"),
    )
    last_kind, last_at = F.col("_last") % 4, F.shiftright("_last", 2)
    revived = F.coalesce(F.col("_extracted_at") > last_at, F.lit(False))
    status = (
        F.when(last_kind == 1, F.lit("complete"))
        .when((last_kind == 2) & ~revived, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    return folded.select(key, status.alias("summary_status"), "events")
