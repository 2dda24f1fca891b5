"""Classification of error texts and retry timing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.lookups import RETRY_DELAYS, RETRYABLE_HTTP, RETRYABLE_MARKERS


def connection_error_class(text: Column) -> Column:
    """``refused, host, auth, timeout, tls`` or ``other``; the first matching rule wins."""
    low = F.lower(text)
    return (
        F.when(low.rlike("connection refused|errno 111"), F.lit("refused"))
        .when(low.rlike("no such host|nodename nor servname|name or service not known"), F.lit("host"))
        .when(F.contains(low, F.lit("auth")), F.lit("auth"))
        .when(low.rlike("timed out|timeout"), F.lit("timeout"))
        .when(low.rlike("ssl|tls|certificate"), F.lit("tls"))
        .otherwise(F.lit("other"))
    )


def connection_error_message(text: Column) -> Column:
    """What to tell the user about a failed store connection."""
    kind = connection_error_class(text)
    return (
        F.when(kind == "refused", F.lit("Nothing answers at the store's address: it seems to be switched off."))
        .when(kind == "host", F.lit("The store's host name is unknown; the address in the settings may be wrong."))
        .when(kind == "auth", F.lit("The store refused the user name or the password."))
        .when(kind == "timeout", F.lit("No answer from the store in time."))
        .when(kind == "tls", F.lit("No encrypted connection to the store: its certificate was not accepted."))
        .otherwise(F.concat(F.lit("Connection failed: "), text))
    )


def is_retryable(error: Column) -> Column:
    """Transient failures: overload and gateway statuses, timeouts, broken connections (case-sensitive)."""
    codes = "|".join(str(code) for code in RETRYABLE_HTTP)
    return F.coalesce(error.rlike(f"HTTP (?:{codes})|" + "|".join(RETRYABLE_MARKERS)), F.lit(False))


def retry_delay(error: Column, attempt: int) -> Column:
    """Seconds to wait before retry ``attempt`` (0-based): the default, or a longer Retry-After."""
    asked = F.regexp_extract(error, r"Retry-After: ([^s]*)s", 1)
    wanted = F.trim(asked).try_cast("int")
    return F.greatest(F.lit(RETRY_DELAYS[attempt]), F.coalesce(wanted, F.lit(0)))


def exhausted(error: Column) -> Column:
    return F.concat(F.lit(f"Failed after {len(RETRY_DELAYS) + 1} attempts. Last error: "), error)


def error_body(body: Column) -> Column:
    """The message inside a JSON error body, else the whole body itself."""
    message = F.coalesce(
        F.nullif(F.get_json_object(body, "$.error.message"), F.lit("")),
        F.nullif(F.get_json_object(body, "$.message"), F.lit("")),
        F.nullif(F.get_json_object(body, "$.detail"), F.lit("")),
    )
    # An "error" that is not an object has no message to offer, and then the whole body is shown.
    error = F.get_json_object(body, "$.error")
    usable = error.isNull() | F.startswith(error, F.lit("{"))
    return F.coalesce(F.when(usable, message), body)


def api_error(status: Column, request_id: Column, retry_after: Column, remaining: Column, body: Column) -> Column:
    """One line for a failed API call; absent parts are left out."""

    def part(label: str, value: Column, unit: str = "") -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit(unit)))

    return F.concat_ws(
        " | ",
        F.concat(F.lit("API returned HTTP "), status.cast("string")),
        part("Request-ID: ", request_id),
        part("Retry-After: ", retry_after, "s"),
        part("Rate-limit remaining: ", remaining),
        F.concat(F.lit("Response: "), error_body(body)),
    )
