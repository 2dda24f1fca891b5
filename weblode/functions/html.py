"""Link extraction and page predicates over raw HTML.

The main path is regular expressions inside the JVM: comments and raw-text elements are removed
first, then start tags are matched with quote-aware patterns.  Markup those patterns cannot read
exactly goes to a small standard-library parser through Arrow; the other rows pass a null there, so
one scan serves both.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.binding import bind
from weblode.functions.text import strip
from weblode.lookups import SCRIPT_REDIRECT_MARKERS

# What is never ended takes the rest of the page, as in browsers.  So each pattern passes over the page once: it never
# starts again at an opener inside what it has consumed.  The alternatives share their first character, so that any
# other place is passed over by one comparison.
_INERT = (
    "(?is)<(?:!--(?:.*?-->|.*+)"
    + "".join(rf"|{name}(?=[\s/>])(?:.*?</{name}\s*+>|.*+)" for name in ("script", "style", "textarea", "title"))
    + ")"
)
_OPENED = r"<(?:a|embed|object|iframe)(?=[\s/])"
_ENDED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_WHOLE_TAG = _OPENED + _ENDED
_START_TAG = rf"(?is){_OPENED}(?:{_ENDED}|.*+)"
_ATTRIBUTE = (
    r"""(?is)^<{tag}(?:[\s/]+(?!{name}[\s=])[^\s=>/"']+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?)*+"""
    r"""[\s/]+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
)
_HREF = _ATTRIBUTE.format(tag="a", name="href")
_SRC = _ATTRIBUTE.format(tag="(?:embed|object|iframe)", name="src")
_QUOTES = r"""^["']|["']$"""
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_RARE_ENTITY = r"&(?!(?:quot|#39|lt|gt|amp);)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]*;)"

LINK_FIELDS = T.ArrayType(T.StructType().add("kind", "string").add("href", "string"))


def _unescape(value: str) -> str:
    for entity, char in _ENTITIES:
        value = f"replace({value}, {_sql_text(entity)}, {_sql_text(char)})"
    return value


def _parse_hrefs(html: str) -> list[tuple[str, str]]:
    from html.parser import HTMLParser

    found: list[tuple[str, str]] = []

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            wanted = {"a": "href", "embed": "src", "object": "src", "iframe": "src"}.get(tag)
            for name, value in attrs:
                if name == wanted and value is not None:
                    found.append(("anchor" if tag == "a" else "embed", value))
                    break

    parser = Links()
    parser.feed(html)
    parser.close()
    return found


@F.pandas_udf(LINK_FIELDS)
def _parsed_links(html: pd.Series) -> pd.Series:
    return html.map(
        lambda text: None if text is None else [{"kind": kind, "href": href} for kind, href in _parse_hrefs(text)]
    )


def start_tags(html: Column) -> Column:
    """The start tags that may carry links, as written, in document order."""
    found = F.regexp_extract_all(F.regexp_replace(html, _INERT, ""), F.lit(_START_TAG), F.lit(0))
    # At most the last one is unended, and then it is no tag.
    return F.filter(found, lambda tag: tag.rlike(rf"(?is)^{_WHOLE_TAG}\z"))


def needs_parser(html: Column, tags: Column) -> Column:
    """Pages whose links the patterns may misread.

    CDATA or markup-in-comment leftovers, a start tag broken off by another one, attributes without
    a space between them, or a rare character reference inside a tag.
    """
    odd = rf"""{_RARE_ENTITY}|^<[a-zA-Z]+\s[^>"']*<|["'](?:href|src)\s*="""
    return F.exists(tags, lambda tag: tag.rlike("(?is)" + odd)) | F.contains(html, F.lit("<![CDATA["))


def _sql_text(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tag_link(tag: str) -> str:
    """SQL: ``struct(kind, href)`` of a start tag; the address is empty where the tag has none."""
    return bind(
        f"{tag} RLIKE {_sql_text(r'(?i)^<a[\s/]')}",
        lambda anchor: (
            f"named_struct('kind', CASE WHEN {anchor} THEN 'anchor' ELSE 'embed' END, 'href', "
            + _unescape(
                f"regexp_replace(CASE WHEN {anchor} THEN regexp_extract({tag}, {_sql_text(_HREF)}, 1) "
                f"ELSE regexp_extract({tag}, {_sql_text(_SRC)}, 1) END, {_sql_text(_QUOTES)}, '')"
            )
            + ")"
        ),
    )


def with_page_links(pages: DataFrame, name: str = "found", parser_fallback: bool = True) -> DataFrame:
    """Add ``name``: the page's links in document order, ``array<struct<kind, href>>``.

    Kept are anchors and embedded sources with a non-empty address, whitespace trimmed.  Anchors to
    fragments, scripts, mail and phone numbers are dropped (case-sensitively); embedded sources stay
    whatever their scheme.  Steps are separate columns so each pattern runs once over the page.
    """
    tagged = pages.withColumn("_tags", start_tags(F.col("html")))
    found = F.expr(f"transform(_tags, tag -> {_tag_link('tag')})")
    if parser_fallback:
        tagged = tagged.withColumn("_hard", needs_parser(F.col("html"), F.col("_tags")))
        tagged = tagged.withColumn("_parsed", _parsed_links(F.when(F.col("_hard"), F.col("html"))))
        found = F.when(F.col("_hard"), F.col("_parsed")).otherwise(found)
    trimmed = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), strip(x["href"]).alias("href")))
    dropped = _sql_text("^(?:#|javascript:|mailto:|tel:)")
    kept = F.call_function(
        "filter", trimmed, F.expr(f"x -> x.href <> '' AND (x.kind = 'embed' OR NOT x.href RLIKE {dropped})")
    )
    return tagged.withColumn(name, kept).drop("_tags", "_hard", "_parsed")


def is_script_redirect(html: Column, max_chars: int | None = 500) -> Column:
    """Pages shorter than ``max_chars`` (any length when None) that only move the browser elsewhere."""
    markers = "|".join(marker.replace(".", r"\.") for marker in SCRIPT_REDIRECT_MARKERS)
    short = F.lit(True) if max_chars is None else F.length(html) < max_chars
    return F.coalesce(short & F.lower(html).rlike(markers), F.lit(False))


def is_minimal(html: Column, link_count: Column, max_chars: int | None = 2000) -> Column:
    """Pages without links and with less than ``max_chars`` of markup (any when None), worth a rendered fetch."""
    short = F.lit(True) if max_chars is None else F.length(html) < max_chars
    return F.coalesce((link_count == 0) & short, F.lit(False))
