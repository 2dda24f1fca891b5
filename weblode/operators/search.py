"""Filtered and ranked search over the document store.

Ranking here is this engine's own: words in lower case, OR-ed, scored by how often they occur over
six fields.  Quoted phrases must occur and ``-word`` must not.  There is no stemming and no stop-word
list.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.text import preview

FIELDS = ["filename", "extracted_text", "summary", "short_summary", "title", "keywords"]
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def query_terms(query: str) -> tuple[list[str], list[str], list[str]]:
    """(words, phrases, excluded words) of a search text, in lower case."""
    text = query.lower()
    phrases = [p for p in re.findall(r'"([^"]+)"', text) if p.strip()]
    rest = re.sub(r'"[^"]*"', " ", text).split()
    excluded = [w[1:] for w in rest if w.startswith("-") and len(w) > 1]
    plain = " ".join([w for w in rest if not w.startswith("-")] + phrases)
    words = list(dict.fromkeys(w for w in re.split(r"[^\w]+|_", plain) if w))
    return words, phrases, excluded


def words_of(field: Column) -> Column:
    return F.split(F.lower(field), _WORD_BREAK)


def _field(name: str) -> Column:
    return F.array_join(F.col(name), " ") if name == "keywords" else F.col(name)


def relevance(words: list[str], fields: list[str]) -> Column:
    """How many words of the fields are query words."""
    # Counted in place: splitting into arrays would copy every text.
    letters = r"[\p{L}\p{N}]"
    choice = "|".join(re.escape(word) for word in sorted(words, key=len, reverse=True))
    pattern = F.lit(f"(?<!{letters})(?:{choice})(?!{letters})")
    hits = [F.coalesce(F.regexp_count(F.lower(_field(name)), pattern), F.lit(0)) for name in fields]
    score = hits[0]
    for more in hits[1:]:
        score = score + more
    return score.cast("bigint")


def _filters(rows: DataFrame, scan_url: str, extension: str) -> DataFrame:
    if scan_url:
        rows = rows.filter(F.col("scan_url") == scan_url)
    if extension:
        rows = rows.filter(F.col("extension") == extension)
    return rows


def _check_limit(limit: int | None) -> None:
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def search(
    store: DataFrame,
    query: str = "",
    scan_url: str = "",
    extension: str = "",
    limit: int | None = 50,
    fields: list[str] | None = None,
) -> DataFrame:
    """Best matches, or the newest documents when there is no text; ``limit`` rows, or all when it is None.

    Scan and extension filters reach the file scan.  The result carries a 300-character preview in
    place of the text.  Sorting with a limit is a per-task top-k.
    """
    _check_limit(limit)
    rows = _filters(store, scan_url, extension)
    shown = [F.col(c) for c in store.columns if c != "extracted_text"]
    shown.append(preview(F.col("extracted_text")).alias("extracted_text_preview"))
    if not query.strip():
        return _first(rows.orderBy(F.desc("downloaded_at"), "_id"), limit).select(*shown)
    fields = fields or [f for f in FIELDS if f in store.columns]
    words, phrases, excluded = query_terms(query)
    everything = F.lower(F.concat_ws("\n", *[_field(f) for f in fields]))
    for phrase in phrases:
        rows = rows.filter(F.contains(everything, F.lit(phrase)))
    if excluded:
        rows = rows.filter(relevance(excluded, fields) == 0)
    # The score is computed once, before the top-k; only the winners' rows are projected.
    scored = rows.withColumn("score", relevance(words, fields)) if words else rows.withColumn("score", F.lit(0).cast("bigint"))
    return _first(scored.filter(F.col("score") > 0).orderBy(F.desc("score"), "_id"), limit).select(*shown, "score")


def build_index(store: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Inverted index ``word, _id, frequency`` for many searches over one snapshot.

    Words are counted inside each document before anything is shuffled, and rows are keyed by word
    *and* document, so a word found everywhere spreads out.  Write it sorted by word
    (``sinks.tables.write_clustered``) and a search reads only the row groups of its words.
    """
    fields = fields or [f for f in FIELDS if f in store.columns]
    words = F.flatten(F.array(*[F.coalesce(words_of(_field(f)), F.array().cast("array<string>")) for f in fields]))
    return (
        store.select("_id", F.explode(words).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("word", "_id")
        .agg(F.count("*").alias("frequency"))
    )


#: How a word of the index can hold a part of a phrase.
_FITS = {"is": lambda word, part: word == part, "ends": F.endswith, "begins": F.startswith, "holds": F.contains}


def _demands(phrase: str) -> list[tuple[str, str]]:
    """What words a text with the phrase must have: its outer ones may be the end and the beginning of longer words."""
    parts = re.split(r"[^\w]+|_", phrase)
    last = len(parts) - 1
    kinds = ["ends", *["is"] * (last - 1), "begins"] if last else ["holds"]
    return [(kind, part) for kind, part in zip(kinds, parts, strict=True) if part]


def search_index(
    index: DataFrame,
    query: str,
    limit: int | None = 50,
    store: DataFrame | None = None,
    scan_url: str = "",
    extension: str = "",
    fields: list[str] | None = None,
) -> DataFrame:
    """The answer of :func:`search` from an inverted index: ``_id, score``, or with ``store`` its rows as there.

    Words are summed and excluded words removed within the index.  Phrases and filters need ``store`` (the snapshot
    the index was built from, over the same ``fields``) and are checked on the documents whose words can hold the
    phrases, never on the whole store.  As in the scan, a phrase may begin and end inside words.
    """
    _check_limit(limit)
    words, phrases, excluded = query_terms(query)
    if (phrases or scan_url or extension) and store is None:
        raise ValueError("phrases and filters need the store")
    word = F.col("word")
    query_word = word.isin(words)
    demands = list(dict.fromkeys(d for p in phrases for d in _demands(p)))
    fits = [_FITS[kind](word, F.lit(part)) for kind, part in demands]
    hits = index.filter(reduce(or_, fits, query_word)).groupBy("_id").agg(
        F.sum(F.when(query_word, F.col("frequency"))).alias("score"), *[F.bool_or(fit).alias(f"_fit{k}") for k, fit in enumerate(fits)]
    )
    scored = hits.filter(reduce(and_, [F.col(f"_fit{k}") for k in range(len(fits))], F.col("score") > 0)).select("_id", "score")
    if excluded:
        # An excluded text may hold several words; documents with any of them go, as in the scan.
        gone = index.filter(F.col("word").isin(excluded)).select("_id").distinct()
        scored = scored.join(gone, "_id", "left_anti")
    if store is None:
        return _first(scored.orderBy(F.desc("score"), "_id"), limit)
    rows = _filters(store, scan_url, extension).join(scored, "_id")
    fields = fields or [f for f in FIELDS if f in store.columns]
    everything = F.lower(F.concat_ws("\n", *[_field(f) for f in fields]))
    for phrase in phrases:
        rows = rows.filter(F.contains(everything, F.lit(phrase)))
    shown = [F.col(c) for c in store.columns if c != "extracted_text"]
    shown.append(preview(F.col("extracted_text")).alias("extracted_text_preview"))
    return _first(rows.orderBy(F.desc("score"), "_id"), limit).select(*shown, "score")
