"""Connectors to text and summary services.  Network access is an injected function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.errors import api_error, exhausted, is_retryable, retry_delay
from weblode.functions.replies import parse_reply, request_body, response_text
from weblode.lookups import RETRY_DELAYS

#: The reply contract: the keys a reply must have.
REPLY_KEYS = ("title", "short_summary", "summary", "keywords", "document_type")

_REPLY_FORM = (
    "Answer with nothing but a JSON object. Its keys are " + ", ".join(REPLY_KEYS) + "; keywords is a list of strings, "
    "every other value is a string. Keep the title to one line, short_summary to what fits a search result, and let "
    "summary say what a reader needs to decide whether to open the file. "
)
TEXT_SYSTEM = "You catalogue files found on web sites. Below is the text of one file, or of one part of it. " + _REPLY_FORM + (
    "Name in document_type what kind of document it is, in one lower-case word."
)
SHEET_SYSTEM = "You catalogue tables found on web sites. Below are the sheets of one file with column names and a few rows. " + (
    _REPLY_FORM + 'Say what the rows stand for and what can be looked up in them. document_type is "spreadsheet".'
)


def is_available(client: Callable[[str], dict], url: str) -> bool:
    """Whether a text service is configured and answers its status address."""
    return bool(url) and client(f"{url}/api/v1/info/status").get("status") == 200


def convert_files(files: DataFrame, key: str, convert: Callable[[bytes], str | None], name: str) -> DataFrame:
    """``key, name``: a text service applied to each file; a failing call gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, data in zip(batch[key], batch["content"]):
                try:
                    text = None if data is None else convert(bytes(data))
                except Exception:
                    text = None
                yield pd.DataFrame({key: [one], name: [text]}, dtype="object")

    schema = T.StructType([files.schema[key], T.StructField(name, T.StringType())])
    return files.select(key, "content").mapInPandas(run, schema)


def ocr_text(ocr: Callable[[bytes], bytes | None], read: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    """OCR a file, then read the text back; an answer that can't be read is no document."""

    def convert(data: bytes) -> str | None:
        scanned = ocr(data)
        return ((read(scanned) if scanned else None) or "").strip() or None

    return convert


def first_of(*converters: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    """The first converter that gives text, the cheap ones first."""

    def convert(data: bytes) -> str | None:
        for one in converters:
            text = one(data)
            if text:
                return text
        return None

    return convert


def reextract(candidates: DataFrame, fast=None, ocr=None) -> DataFrame:
    """Attempts for ``_id, extension, content`` rows: standard text, then the services for PDFs that still lack it.

    Each stage runs on what the one before left over.
    """
    from weblode.sources.files import extract_text

    tried = extract_text(candidates).withColumn("has_blob", F.col("content").isNotNull())
    tried = tried.withColumn("standard_text", F.nullif("extracted_text", F.lit("")))
    result = tried
    need = tried.filter(F.col("standard_text").isNull() & (F.lower("extension") == ".pdf") & F.col("has_blob"))
    for name, service in (("fast_text", fast), ("ocr_text", ocr)):
        if service is None:
            result = result.withColumn(name, F.lit(None).cast("string"))
            continue
        got = convert_files(need.select("_id", "content"), "_id", service, name)
        result = result.join(got, "_id", "left")
        need = need.join(got.filter(F.coalesce(name, F.lit("")) != "").select("_id"), "_id", "left_anti")
    return result.select("_id", "extension", "has_blob", "standard_text", "fast_text", "ocr_text")


REPLY_ROW = (
    T.StructType()
    .add("_id", "string").add("status", "integer").add("request_id", "string").add("retry_after", "string")
    .add("remaining", "string").add("body", "string").add("failure", "string")
)


def call_once(requests: DataFrame, post: Callable[[str], dict], parallel: int = 4, gap: float = 0.0) -> DataFrame:
    """Post each ``_id, request`` row; the reply's parts as columns, a raised error as ``failure``.

    At most ``parallel`` calls are in flight, each followed by ``gap`` seconds; replies leave one by one.
    """
    names = REPLY_ROW.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, request in zip(batch["_id"], batch["request"]):
                try:
                    reply = post(request)
                except Exception as error:
                    reply = {"failure": f"{type(error).__name__}: {error}"}
                yield pd.DataFrame([{"_id": key, **reply}], columns=names, dtype="object")
                if gap:
                    time.sleep(gap)

    spread = requests.select("_id", "request").repartition(parallel, "_id")
    return spread.mapInPandas(run, REPLY_ROW)


def summarize(
    prompts: DataFrame, post: Callable[[str], dict], api_url: str, model: str, pause=time.sleep, max_tokens: int = 1024
) -> DataFrame:
    """``_id`` plus reply fields for ``_id, kind, prompt`` rows.

    Transient failures are retried as batches: all that failed so are sent again together after the
    longest wait any of them asks for.  Replies are written out between rounds, so no call repeats.
    """
    from weblode.functions.replies import provider_of
    from weblode.session import materialize

    provider = provider_of(F.lit(api_url))
    system = F.when(F.col("kind") == "sheet", F.lit(SHEET_SYSTEM)).otherwise(F.lit(TEXT_SYSTEM))
    requests = prompts.select("_id", request_body(provider, model, system, F.col("prompt"), max_tokens).alias("request"))

    def judged(replies: DataFrame) -> DataFrame:
        text = response_text(provider, F.col("body"))
        parsed = parse_reply(text)
        problem = F.when(F.col("failure").isNotNull(), F.col("failure")).when(
            F.col("status") != 200,
            api_error(F.col("status"), F.col("request_id"), F.col("retry_after"), F.col("remaining"), F.col("body")),
        )
        problem = problem.when(text == "", F.lit("API returned empty response content"))
        return (
            replies.withColumn("_problem", problem)
            .withColumn("_reply", parsed)
            .select(
                "_id",
                *[
                    F.when(F.col("_problem").isNull(), F.col(f"_reply.{n}")).alias(n)
                    for n in ("title", "short_summary", "summary", "keywords", "document_type")
                ],
                F.coalesce("_problem", "_reply.error").alias("error"),
            )
        )

    results = materialize(judged(call_once(requests, post)), "replies")
    for attempt in range(len(RETRY_DELAYS)):
        again = results.filter(is_retryable(F.col("error")))
        wait = again.agg(F.max(retry_delay(F.col("error"), attempt))).first()[0]
        if wait is None:
            return results
        pause(wait)
        redo = judged(call_once(requests.join(again.select("_id"), "_id", "left_semi"), post))
        results = materialize(results.join(again.select("_id"), "_id", "left_anti").unionByName(redo), "replies")
    failed = is_retryable(F.col("error"))
    return results.withColumn("error", F.when(failed, exhausted(F.col("error"))).otherwise(F.col("error")))


def summarize_parts(
    prompts: DataFrame, post: Callable[[str], dict], api_url: str, model: str, pause=time.sleep, max_tokens: int = 1024
) -> DataFrame:
    """Reply fields per ``_id`` for ``_id, filename, kind, part, parts, prompt`` rows.

    The parts of a long text are summarized each, then their summaries in order are summarized as one text, in
    parts again where they are still long.  A document of which a part fails has that part's error.
    """
    from weblode.operators.enrich import PROMPT_CHARS, prompt_rows
    from weblode.session import materialize

    done = None
    while True:
        calls = prompts.select(F.concat_ws("\n", "_id", "part").alias("_id"), "kind", "prompt")
        replies = summarize(calls, post, api_url, model, pause, max_tokens).withColumnRenamed("_id", "_call")
        parts = prompts.withColumn("_call", F.concat_ws("\n", "_id", "part")).join(replies, "_call").drop("_call", "prompt")
        parts = materialize(parts, "reply-parts")
        names = [n for n in replies.columns if n != "_call"]
        failed = parts.filter("parts > 1 AND error IS NOT NULL").groupBy("_id").agg(F.min_by("error", "part").alias("error"))
        single = parts.filter("parts = 1").select("_id", *names)
        lost = failed.select("_id", *[F.lit(None).cast(parts.schema[n].dataType).alias(n) if n != "error" else "error" for n in names])
        done = single.unionByName(lost) if done is None else done.unionByName(single).unionByName(lost)
        more = parts.filter("parts > 1").join(failed, "_id", "left_anti")
        if more.isEmpty():
            return done
        # A document's parts are as many as its text is long; only their summaries meet.
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]), "\n\n")
        bodies = more.groupBy("_id").agg(
            F.first("filename").alias("filename"), F.first("kind").alias("kind"), F.max("parts").alias("_before"), listed.alias("body")
        )
        again = prompt_rows(bodies.drop("_before"), PROMPT_CHARS).join(bodies.select("_id", "_before"), "_id")
        whole = prompt_rows(bodies.drop("_before"), None)
        # Summaries that do not get shorter are sent whole, so the rounds end.
        stuck = again.filter("parts >= _before").select("_id").distinct()
        prompts = again.drop("_before").join(stuck, "_id", "left_anti").unionByName(whole.join(stuck, "_id", "left_semi"))
        prompts = materialize(prompts, "reply-prompts")
