"""Requests to and replies from the summary service, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.binding import let
from weblode.functions.text import strip


def provider_of(api_url: Column) -> Column:
    """Request style by address; everything unknown speaks the chat-completions style."""
    return F.when(F.contains(F.lower(api_url), F.lit("anthropic")), F.lit("anthropic")).otherwise(F.lit("openai"))


def request_body(provider: Column, model: str, system: Column, prompt: Column, max_tokens: int = 1024) -> Column:
    """JSON body of one request."""
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    messages_style = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.lit(max_tokens).alias("max_tokens"),
            system.alias("system"),
            F.array(user).alias("messages"),
        )
    )
    chat_style = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.lit(max_tokens).alias("max_completion_tokens"),
            F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), user).alias("messages"),
        )
    )
    return F.when(provider == "anthropic", messages_style).otherwise(chat_style)


def response_text(provider: Column, body: Column) -> Column:
    """The generated text in a response body, or empty."""
    messages_style = F.get_json_object(body, "$.content[0].text")
    # A first choice decides even when it is empty; only without choices the flat field counts.
    chat_style = F.when(
        F.get_json_object(body, "$.choices[0]").isNotNull(), F.get_json_object(body, "$.choices[0].message.content")
    ).otherwise(F.get_json_object(body, "$.output_text"))
    return F.coalesce(F.when(provider == "anthropic", messages_style).otherwise(chat_style), F.lit(""))


def unfence(raw: Column) -> Column:
    """Stripped text without code-fence lines, when it starts with a fence."""

    def clean(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: ~F.startswith(strip(line), F.lit("```")))
        return F.when(F.startswith(text, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(text)

    return let(strip(raw), clean)


def _text_of(value: Column) -> Column:
    return value.cast("string")


def _truthy(value: Column) -> Column:
    """Whether a JSON value counts as set: not null, false, zero, or empty."""
    kind, text = F.schema_of_variant(value), F.coalesce(value.cast("string"), F.lit(""))
    number = kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT)") & (text.try_cast("double") == 0)
    empty = text.isin("", "[]", "{}") | (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false"))
    return ~F.coalesce(number, F.lit(False)) & ~F.coalesce(empty, F.lit(True))


def parse_reply(raw: Column) -> Column:
    """Struct of the reply fields, or ``error`` set when the reply is unusable.

    The summary must be a non-empty *string*; keywords that are no list become an empty one, empty
    ones are dropped and the rest turned to text; a missing type is ``other``.
    """

    def read(text: Column) -> Column:
        return let(F.try_parse_json(text), lambda v: _fields(v, raw))

    return let(unfence(raw), read)


def _fields(value: Column, raw: Column) -> Column:
    def get(name: str) -> Column:
        return F.variant_get(value, f"$.{name}", "variant")

    def text(name: str) -> Column:
        return F.when(_truthy(get(name)), strip(_text_of(get(name)))).otherwise(F.lit(""))

    is_object = F.startswith(F.coalesce(F.schema_of_variant(value), F.lit("")), F.lit("OBJECT"))
    summary = get("summary")
    valid = (
        is_object
        & (F.schema_of_variant(summary) == "STRING")
        & (F.coalesce(_text_of(summary), F.lit("")) != "")
    )
    listed = F.startswith(F.schema_of_variant(get("keywords")), F.lit("ARRAY"))
    items = F.coalesce(F.try_variant_get(value, "$.keywords", "array<variant>"), F.array().cast("array<variant>"))
    keywords = F.transform(F.filter(items, _truthy), lambda item: strip(_text_of(item)))
    kind = F.when(get("document_type").isNull(), F.lit("other")).otherwise(strip(_text_of(get("document_type"))))
    ok = F.coalesce(valid, F.lit(False))
    problem = F.concat(F.lit("Failed to parse response as JSON: "), raw)
    return F.struct(
        F.when(ok, text("title")).alias("title"),
        F.when(ok, text("short_summary")).alias("short_summary"),
        F.when(ok, strip(_text_of(summary))).alias("summary"),
        F.when(ok, F.when(F.coalesce(listed, F.lit(False)), keywords).otherwise(F.array().cast("array<string>"))).alias(
            "keywords"
        ),
        F.when(ok, kind).alias("document_type"),
        F.when(~ok, problem).alias("error"),
    )
