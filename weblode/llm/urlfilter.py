"""Allow or block addresses by rules, and pass blocks on to the other addresses of the same resource.

A rule is a host with a path prefix, ``example.net/en/``; it fits its host and all subdomains, and the longest fitting
rule decides (an allow among equally long ones).  An address that no rule fits is judged with its aliases: the addresses
connected to it by redirects and canonical links.  If a rule blocks one of them it is blocked too, unless a rule
explicitly allows one of them.  Addresses with a rule of their own keep that rule's verdict in any company.

Scale.  Markup is read once, into a narrow table of addresses.  Rules meet each different host once, by equality on the
host's endings, not each page.  Aliases are found by contraction of the edge table; a class of a third of all addresses
is a label on rows, folded into two flags before the shuffle.  All of it is DataFrame and SQL functions.

Defined cases.  A null address, or one without ``://``, has empty host and path, no rule, and is allowed.  Null markup
has no links.  Repeated rows are judged one by one, alike.  Without redirects or links the rules alone decide; without
rules everything is allowed.  An empty table gives an empty result.  Extra columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.url import resolve_url
from weblode.llm.components import components
from weblode.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parts of a page that hold no tags of it.  What is never ended takes the rest.
_INERT = "(?is)<!--(?:.*?-->|.*+)" + "".join(
    rf"|<{name}(?=[\s/>])(?:.*?</{name}\s*+>|.*+)" for name in ("script", "style", "textarea", "title", "template", "noscript")
)
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?s)[^\s=>"'/]+\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
_REFRESH = r"""(?is)^\s*+[0-9.]++\s*+[;,\s]\s*+(?:url\s*+=\s*+)?(["']?)(.*?)\1\s*$"""
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """An address as a node: scheme and host in lower case, no fragment; null unless it has a host."""
    bare = F.regexp_replace(F.trim(url), "(?s)#.*", "")
    start = F.translate(F.regexp_extract(bare, "^[^/?#]*://[^/?#]+", 0), UPPER, LOWER)
    return F.when(start != "", F.concat(start, F.substr(bare, F.length(start) + 1)))


def _value(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if it has none."""
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    own = F.filter(pairs, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == name)
    value = F.regexp_replace(F.regexp_replace(F.get(own, F.lit(0)), r"(?s)^[^=]*+=\s*+", ""), r"""^["']|["']$""", "")
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.trim(value)


def page_targets(pages: DataFrame, url: str, html: str, *keep: Column) -> DataFrame:
    """``keep`` and ``targets``: the absolute addresses a page says it stands for or sends its readers to.

    Read are ``link`` tags with ``rel=canonical`` and ``meta`` tags that refresh, outside of comments and raw text,
    resolved against the page's ``base`` if it has one.
    """
    body = F.when(F.col(html).rlike("(?i)canonical|refresh"), F.col(html))
    tagged = pages.select(
        *keep, F.col(url).alias("_page"), F.regexp_extract_all(F.regexp_replace(body, _INERT, ""), F.lit(_TAG), F.lit(0)).alias("_tags")
    )

    def target(tag: Column) -> Column:
        canonical = F.array_contains(F.split(F.lower(_value(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(_value(tag, "http-equiv")) == "refresh"
        return (
            F.when(tag.rlike(r"(?i)^<link[\s/]") & canonical, _value(tag, "href"))
            .when(tag.rlike(r"(?i)^<meta[\s/]") & refresh, F.regexp_extract(_value(tag, "content"), _REFRESH, 2))
        )

    bases = F.filter(F.transform(F.filter("_tags", lambda t: t.rlike(r"(?i)^<base[\s/]")), lambda t: _value(t, "href")), lambda v: v != "")
    found = F.filter(F.transform("_tags", target), lambda v: v != "")
    based = tagged.withColumns({"_base": F.get(bases, F.lit(0)), "_found": found})
    rooted = based.withColumn("_root", F.when(F.col("_base").isNull(), F.col("_page")).otherwise(resolve_url(F.col("_base"), F.col("_page"))))
    targets = F.transform("_found", lambda v: resolve_url(v, F.col("_root")))
    return rooted.withColumn("targets", targets).drop("_page", "_tags", "_base", "_found", "_root")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rule, verdict`` of a list such as ``[("block", "net/"), ("allow", "org/fr/")]``."""
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for verdict, rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.sql("SELECT '' AS rule, '' AS verdict LIMIT 0")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``; null where no rule fits."""
    lists = rules.select(
        "rule",
        "verdict",
        F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER).alias("rule_host"),
        F.regexp_extract("rule", "(?s)^[^/]*(.*)", 1).alias("prefix"),
    )
    # Host endings of at most as many labels as some rule has.
    labels = lists.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    endings = F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)])
    hosts = urls.filter("host <> ''").select("host").distinct()
    ends = hosts.select("host", F.explode(F.array_distinct(endings)).alias("rule_host")) if labels else hosts.select("host", "host").toDF("host", "rule_host")
    # A stored table: rows of a frequent host meet it in a plain join, which Spark may split or broadcast by size.
    known = materialize(
        ends.join(lists, "rule_host")
        .groupBy(F.col("host").alias("known_host"))
        .agg(F.collect_list(F.struct("rule", "verdict", "prefix")).alias("candidates")),
        "url-hosts",
    )
    fit = F.filter("candidates", lambda r: F.startswith(F.col("path"), r["prefix"]))
    best = F.array_max(
        F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "allow").alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    )
    joined = urls.join(known, F.col("host") == F.col("known_host"), "left").withColumn("_best", best)
    return joined.withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best", "known_host", "candidates")


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``node, class_verdict`` for the addresses of an edge table ``src, dst`` whose class is blocked."""
    named = materialize(edges.select("src", "dst", F.md5("src").alias("a"), F.md5("dst").alias("b")), "url-edges")
    ends = named.select(F.col("src").alias("url"), F.col("a").alias("node")).union(named.select("dst", "b")).distinct()
    own = ruled(ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    labels = materialize(components(named, "a", "b").join(own.select("node", "rule_verdict"), "node"), "url-classes")
    flags = labels.groupBy("root").agg(
        F.bool_or(F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("block"),
        F.bool_or(F.coalesce(F.col("rule_verdict") == "allow", F.lit(False))).alias("allow"),
    )
    return labels.join(flags.filter("block AND NOT allow").select("root"), "root", "left_semi").select("node", F.lit("block").alias("class_verdict"))


def judged(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Per page: ``page_id, url, host, path, rule, verdict``.

    ``redirects`` may hold more edges, recorded while fetching, as absolute addresses ``src, dst``.
    """
    address = F.col(f"`{url}`")
    given = pages.select(F.col(f"`{key}`").alias("page_id"), address.alias("url"), F.col(f"`{html}`").alias("html"))
    narrow = materialize(
        page_targets(given, "url", "html", F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
        "url-pages",
    )
    edges = narrow.select(F.col("url").alias("src"), F.explode("targets").alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
    classes = alias_verdicts(edges.filter("src <> dst").distinct(), rules)
    own = ruled(narrow.drop("targets"), rules).withColumn("_node", F.md5(alias_key(F.col("url"))))
    return own.join(classes, F.col("_node") == F.col("node"), "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict")
    )
