"""String helpers with the whitespace, truncation and naming rules used across the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.lookups import DEFAULT_MIME, MIME_TYPES, TYPE_LABELS, WHITESPACE, lookup


def strip(value: Column) -> Column:
    """Trim Unicode whitespace on both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(value), F.lit("")) == ""


def is_missing(value: Column) -> Column:
    """True for null and empty text."""
    return F.coalesce(value, F.lit("")) == ""


def or_else(value: Column, fallback: Column | str) -> Column:
    """``value`` unless it is null or empty."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(is_missing(value), other).otherwise(value)


def preview(text: Column, length: int = 300) -> Column:
    """The first ``length`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def truncate(text: Column, max_length: int) -> Column:
    """Cut to ``max_length`` characters, the ellipsis included."""
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    ).otherwise(text)


def escape_html(text: Column) -> Column:
    """Escape the characters that are markup in HTML text."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def type_label(extension: Column) -> Column:
    """Readable file type of an extension, with or without its dot; unknown ones become ``XYZ File``."""
    ext = strip(F.lower(extension))
    dotted = F.when(F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext))
    return lookup(TYPE_LABELS, dotted, F.concat(F.upper(F.ltrim(dotted, F.lit("."))), F.lit(" File")))


def mime_type(extension: Column) -> Column:
    return lookup(MIME_TYPES, F.lower(extension), DEFAULT_MIME)


def _suffix(filename: Column) -> Column:
    # A leading run of dots is part of the stem, as for hidden files.
    return F.regexp_extract(filename, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def split_name(filename: Column) -> tuple[Column, Column]:
    """(stem, suffix) of a file name; the suffix keeps its dot and may be empty."""
    suffix = _suffix(filename)
    return F.substr(filename, F.lit(1), F.length(filename) - F.length(suffix)), suffix


def sanitize_filename(filename: Column, max_length: int = 200) -> Column:
    """Replace characters file systems reject, trim spaces and dots, and cap the length keeping the suffix."""
    clean = F.btrim(F.regexp_replace(filename, r'[<>:"/\\|?*]', "_"), F.lit(" ."))
    named = or_else(clean, "unnamed_file")
    stem, suffix = split_name(named)
    room = F.lit(max_length) - F.length(suffix)
    # A suffix longer than the whole budget drops characters from the end of the stem instead.
    kept = F.when(room >= 0, room).otherwise(F.greatest(F.length(stem) + room, F.lit(0)))
    return F.when(F.length(named) > max_length, F.concat(F.substr(stem, F.lit(1), kept), suffix)).otherwise(named)


def disposition_filename(header: Column) -> Column:
    """File name in a Content-Disposition header, or null: the text between the first two ``filename=``."""
    part = F.btrim(F.split(header, "filename=")[1], F.lit("\"'"))
    return F.when(F.contains(header, F.lit("filename=")) & (part != ""), part)


def text_parts(text: Column, size: int) -> Column:
    """The whole text in consecutive parts of at most ``size`` characters; one empty part for an empty text."""
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))
    )


def build_prompt(filename: Column, text: Column, part: Column | None = None, parts: Column | None = None) -> Column:
    """User message for the summary service: file name, which part of the text this is if there are several, text."""
    where = F.lit("")
    if part is not None:
        where = F.when(parts > 1, F.format_string(" (part %d of %d)", part, parts)).otherwise(F.lit(""))
    return F.concat(
        F.lit("Document filename: "), filename, F.lit("\n\nDocument content"), where, F.lit(":\n"), text
    )
