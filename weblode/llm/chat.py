"""Format conversations whose turns hold typed content parts.

A visitor flattens the parts of a turn in order: text is escaped and kept, an image, audio or document part
becomes a placeholder with its kind, its ordinal in the conversation and its expanded token count, and is recorded
as an attachment.  All of it is column expressions over arrays; no code runs in Python.

Template: ``<|turn|>role<|says|>content<|end|>`` per turn.  Inside roles, texts and references a control string can not occur:
every escape character is doubled with a ``0`` after it, and the first character of anything that looks like a
control string (``<|``, ``</s>``, ``<s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) gets an escape and a
``1`` after it.  Both are undone in the reverse order, so any text reads back as it was.

Defined cases.  Null texts, roles and parts count as empty.  Turns are ordered by turn (null first), then role and
text, so ties and repeated rows have a fixed place.  A null conversation id is a conversation of its own.  One
conversation is one row by definition, so its turns meet in one task.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.functions.binding import let

ESCAPE = "␛"
OPEN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"

#: How parts expand to tokens.
IMAGE_PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1024

PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return F.regexp_replace(doubled, _CONTROL, "$0" + ESCAPE + "1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def text_part(text: Column) -> Column:
    """A turn's content when it is one plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            *[F.lit(None).cast("bigint").alias(n) for n in ("width", "height")],
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("bigint").alias("pages"),
        )
    ).cast(f"array<{PART}>")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text."""
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    count = (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_PER_SECOND))
        .when(part["type"] == "document", part["pages"] * TOKENS_PER_PAGE)
    )
    return F.coalesce(count, F.lit(0)).cast("bigint")


def _is_held(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _visit(parts: Column, base: Column) -> Column:
    """Flatten the parts of one turn to segments; placeholders are numbered from ``base``."""

    def segment(part: Column, i: Column) -> Column:
        ordinal = base + F.size(F.filter(F.slice(parts, 1, i), _is_held))
        tokens = expanded_tokens(part)
        holder = F.concat_ws(":", F.concat(F.lit("<|"), part["type"]), ordinal.cast("string"), tokens.cast("string"))
        return F.struct(
            F.when(_is_held(part), F.concat(holder, F.lit("|>"))).otherwise(escape(part["text"])).alias("text"),
            _is_held(part).alias("held"),
            F.struct(
                ordinal.cast("bigint").alias("ordinal"),
                part["type"].alias("type"),
                part["ref"].alias("ref"),
                tokens.alias("tokens"),
            ).alias("attachment"),
        )

    return F.transform(parts, segment)


def _spans(segments: Column, start: Column) -> Column:
    """(start, length) of each text segment of a turn whose content begins at ``start``."""
    def spans(lengths: Column) -> Column:
        def span(segment: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("bigint"), lambda n, x: n + x)
            return F.when(
                ~segment["held"] & (F.length(segment["text"]) > 0),
                F.struct((start + before).alias("start"), F.length(segment["text"]).cast("bigint").alias("length")),
            )

        return F.filter(F.transform(segments, span), lambda s: s.isNotNull())

    return let(F.transform(segments, lambda s: F.length(s["text"])), spans)


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conversation, formatted, loss_mask, attachments``.

    ``loss_mask`` lists (start, length) in code points of the content of trained turns, as it stands in the output,
    placeholders left out.  ``attachments`` lists (ordinal, type, ref, tokens).  Turns are rendered row by row; the
    windows and the gathering share one shuffle by conversation.
    """
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_parts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(
        F.col(conversation).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("_parts"),
    )
    held = F.size(F.filter("_parts", _is_held)).cast("bigint")
    placed = rows.withColumns(
        {"_at": F.row_number().over(order), "_base": F.coalesce(F.sum(held).over(earlier), F.lit(0))}
    )
    opening = F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(SAYS))
    drawn = placed.withColumns({"_segments": _visit(F.col("_parts"), F.col("_base")), "_opening": opening})
    drawn = drawn.withColumn(
        "_text",
        F.concat("_opening", F.array_join(F.transform("_segments", lambda s: s["text"]), ""), F.lit(END)),
    )
    laid = drawn.withColumn(
        "_start",
        F.coalesce(F.sum(F.length("_text").cast("bigint")).over(Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    mask = F.when(
        F.col("_role") == trained_role, _spans(F.col("_segments"), F.col("_start") + F.length("_opening"))
    ).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
    attachments = F.transform(F.filter("_segments", lambda s: s["held"]), lambda s: s["attachment"])
    gathered = (
        laid.select("_conv", F.struct("_at", "_text", mask.alias("_mask"), attachments.alias("_files")).alias("_row"))
        .groupBy("_conv")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    return gathered.select(
        F.col("_conv").alias(conversation),
        F.array_join(F.transform("_rows", lambda r: r["_text"]), "").alias("formatted"),
        F.flatten(F.transform("_rows", lambda r: r["_mask"])).alias("loss_mask"),
        F.flatten(F.transform("_rows", lambda r: r["_files"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, placeholders left in the text."""
    bodies = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2147483647 - 2)
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, SAYS, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(b, SAYS, -1), END, 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """What lies under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), ""
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of one formatted text per conversation, read back from the output."""
    chats = format_chats(turns.withColumn("content", text_part(F.col("text"))))
    read = chats.withColumns(
        {"_read": read_turns(F.col("formatted")), "_loss": masked_text(F.col("formatted"), F.col("loss_mask"))}
    )
    line = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
