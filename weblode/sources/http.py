"""Live connectors: pages, file probes and size probes over HTTP.

A connector is a function from URL to a raw response; what the response *means* is decided by column
expressions afterwards, so recorded responses and live ones share their rules.  URLs are spread by
host, and each task keeps its own pause between requests to a host.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.sizes import format_size
from weblode.functions.text import disposition_filename
from weblode.functions.url import domain_of, extension_of_name, filename_of

RESPONSE = (
    T.StructType()
    .add("url", "string").add("status", "integer").add("content_type", "string").add("content_length", "string")
    .add("content_range", "string").add("content_disposition", "string").add("body", "binary").add("failure", "string")
    .add("failure_text", "string")
)

#: Bytes of bodies a task gathers before it hands them on.
BATCH_BYTES = 16 << 20


def urllib_client(method: str = "GET", timeout: float = 30, headers: dict[str, str] | None = None) -> Callable[[str], dict]:
    """A client on the standard library.  ``failure`` is ``timeout``, ``connection`` or ``other``."""

    def fetch(url: str) -> dict:
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, method=method, headers=headers or {})
        try:
            try:
                reply = urllib.request.urlopen(request, timeout=timeout)
            except urllib.error.HTTPError as error:
                reply = error
            with reply:
                h = reply.headers
                return {
                    "status": reply.status, "content_type": h.get("Content-Type"),
                    "content_length": h.get("Content-Length"), "content_range": h.get("Content-Range"),
                    "content_disposition": h.get("Content-Disposition"), "body": reply.read(),
                }
        except TimeoutError as error:
            return {"failure": "timeout", "failure_text": str(error)}
        except urllib.error.URLError as error:
            slow = isinstance(error.reason, TimeoutError)
            return {"failure": "timeout" if slow else "connection", "failure_text": str(error.reason)}
        except Exception as error:
            return {"failure": "other", "failure_text": str(error)}

    return fetch


def request_all(
    urls: DataFrame, client: Callable[[str], dict], partitions: int = 10, delay: float = 0.0, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One response row per URL.  ``partitions`` bounds the requests in flight.

    URLs are spread by host *and* a few salts: one host's pages do not end up in one task.
    """
    names = RESPONSE.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for url in batch["url"]:
                if delay:
                    time.sleep(delay)
                rows.append({"url": url, **client(url)})
                held += len(rows[-1].get("body") or b"")
                if held >= batch_bytes:
                    # Bodies leave by size, not by count: a task holds little more than one batch of bytes.
                    yield pd.DataFrame(rows, columns=names, dtype="object")
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype="object")

    salt = F.pmod(F.xxhash64("url"), F.lit(5))
    spread = urls.select("url").distinct().repartition(partitions, domain_of(F.col("url")), salt)
    return spread.mapInPandas(run, RESPONSE)


def page_error(status: Column, content_type: Column, failure: Column, failure_text: Column) -> Column:
    """Why a response is no page, or null."""
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(failure == "timeout", F.lit("Request timed out"))
        .when(failure == "connection", F.concat(F.lit("Connection error: "), failure_text))
        .when(failure.isNotNull(), F.concat(F.lit("Error: "), failure_text))
        .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~kind.rlike("text/html|application/xhtml"), F.lit("Not an HTML page"))
    )


def pages_from_responses(responses: DataFrame) -> DataFrame:
    """``url, html, warning`` from raw responses."""
    from weblode.sources.files import decode_text

    problem = page_error(F.col("status"), F.col("content_type"), F.col("failure"), F.col("failure_text"))
    judged = responses.withColumn("warning", problem)
    return judged.select("url", F.when(F.col("warning").isNull(), decode_text(F.col("body"))).alias("html"), "warning")


def probed_documents(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Discovered documents from HEAD responses: size, name override, reachability, error.

    ``links``: url, source_page, depth.  Links without a response count as failed.
    """
    joined = links.join(responses.drop("body"), "url", "left")
    ok = F.coalesce(F.col("failure").isNull() & (F.col("status") == 200), F.lit(False))
    size = F.when(ok, F.trim("content_length").try_cast("bigint"))
    plain = filename_of(F.col("url"))
    error = (
        F.when(ok, F.lit(None).cast("string"))
        .when(F.col("failure") == "timeout", F.lit("Timeout"))
        .when(F.col("status").isNotNull(), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .otherwise(F.coalesce("failure_text", F.lit("")))
    )
    return joined.select(
        "url",
        F.coalesce(F.when(ok, disposition_filename(F.col("content_disposition"))), plain).alias("filename"),
        extension_of_name(plain).alias("extension"),
        size.alias("file_size_bytes"),
        format_size(size).alias("file_size_display"),
        "source_page",
        "depth",
        ok.alias("is_accessible"),
        error.alias("error_message"),
    )


def ranged_size(status: Column, content_range: Column, content_length: Column) -> Column:
    """File size from a one-byte range request: the total of a 206, the length of a 200, else null."""
    return F.when(
        status == 206, F.trim(F.try_element_at(F.split(content_range, "/"), F.lit(2))).try_cast("bigint")
    ).when(status == 200, F.trim(content_length).try_cast("bigint"))


def probed_sizes(responses: DataFrame) -> DataFrame:
    """``url, size_bytes, size_display`` from range-request responses."""
    sized = responses.select("url", ranged_size(F.col("status"), F.col("content_range"), F.col("content_length")).alias("size_bytes"))
    return sized.withColumn("size_display", format_size(F.col("size_bytes")))


def failure_reasons(responses: DataFrame) -> DataFrame:
    """``url, reason`` of unreachable files, for the inaccessible log."""
    reason = (
        F.when(F.col("failure") == "timeout", F.lit("TIMEOUT"))
        .when(F.col("failure").isNotNull(), F.concat(F.lit("ERROR: "), F.col("failure_text")))
        .when(~F.col("status").isin(200, 206), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    return responses.select("url", reason.alias("reason")).filter(F.col("reason").isNotNull())
