"""Personal data: fixed kinds by pattern, and terms that reveal them by how they occur together.

The fixed kinds (email, ip, card, phone) are the protected entities.  Words of a document that mentions an entity may
give it away even when the mention itself is gone, wherever they stand.  How much is estimated from the corpus: with n
documents, n_e of them mentioning entity e, n_t holding term t and n_et holding both, the information t gives about e is
log(n_et * n / (n_e * n_t)), out of log(n / n_e) that e carries.  A term whose ratio reaches ``DISCLOSURE`` in
at least ``SUPPORT`` different texts is generalised in the documents that mention e; one that reaches ``REMOVAL``
is removed.  Documents without entities stay as they are.  Everything is column expressions and joins.

As n_et is at most n_e, only terms with n_t up to n_e * (n / n_e) ** (1 - ``DISCLOSURE``) can reach the ratio, so
documents and entities are paired with such terms alone; that leaves out no term.

Offsets are code points.  Matches come from one pass of the pattern over the text: what lies between matches is
split off with the same pattern, and running lengths give the places.  The patterns are written without
backtracking so that long texts stay linear.

Defined cases.  A null text counts as empty and stays null when sanitised.  Rows equal in id and text are treated
alike.  An empty table gives an empty result.  Where spans of several kinds overlap, all are reported and the
earliest (then the first listed) decides the replacement.  Working columns start with ``_pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.binding import let
from weblode.session import materialize

#: Kinds in the order they are listed in, and their patterns.  A card is a maximal chain of digits
#: with single separators, so only chains of the right length need matching.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

TERM = r"\p{L}[\p{L}\p{N}]{2,}"
SUPPORT = 3
DISCLOSURE = 0.9
REMOVAL = 1.0

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks of the square root of the size."""

    def over(array: Column) -> Column:
        # Lambda bodies are evaluated anew for each element, so everything they share is bound to a variable.
        block = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))

        def sums(width: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), width),
                F.array(F.lit(0).cast("bigint")),
                lambda done, j: F.concat(
                    done, F.array(F.element_at(done, -1) + _total(F.slice(array, j * width + 1, width)))
                ),
            )

        def placed(width: Column) -> Column:
            return let(
                sums(width),
                lambda blocks: F.transform(
                    array,
                    lambda x, i: F.get(blocks, F.floor(i / width).cast("int")) + _total(F.slice(array, i - i % width + 1, i % width)),
                ),
            )

        return let(block, placed)

    return let(lengths, over)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), "(?!^)(?=.)"))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_VALID_IP)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return _digits(value).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda span: _valid(kind, span["value"])


def _located(text: str, hits: str, pattern: Column) -> Column:
    """Spans of ``hits``, all matches of the pattern in the text in order."""
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g).cast("bigint"))
    sizes = F.transform(hits, lambda h: F.length(h).cast("bigint"))
    # Each gap is followed by its match, so a match starts at all gaps up to its own and all matches before.
    before = F.concat(F.array(F.lit(0).cast("bigint")), sizes)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.slice(before, 1, F.size(hits)), lambda g, s: g + s)
    spans = let(
        steps,
        lambda moves: F.zip_with(
            F.zip_with(running_before(moves), moves, lambda earlier, own: earlier + own),
            F.col(hits),
            lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).cast("bigint").alias("end"), h.alias("value")),
        ),
    )
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str = "_pii_text") -> DataFrame:
    """Add ``_pii_<kind>`` for the fixed kinds: the valid spans of each."""
    found = docs
    for kind, pattern, hint in (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        if hint:
            hits = F.when(F.contains(F.col(text), F.lit(hint)), hits).otherwise(F.array().cast("array<string>"))
        found = found.withColumn("_pii_hits", hits).withColumn(f"_pii_{kind}", _located(text, "_pii_hits", F.lit(pattern)))
        found = found.withColumn(f"_pii_{kind}", F.filter(f"_pii_{kind}", _is_valid(kind)))
    return found.drop("_pii_hits")


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else F.regexp_replace(value, r"[^0-9.]" if kind == "ip" else "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), plain)


def _mentions(docs: DataFrame) -> DataFrame:
    """``_pii_key, _pii_hash, entity`` for the entities of a document, each once."""

    def named(kind: str):
        return lambda s: _entity(kind, s["value"])

    found = F.array_distinct(F.flatten(F.concat(*[F.array(F.transform(f"_pii_{kind}", named(kind))) for kind in KINDS[:4]])))
    return with_spans(docs).select("_pii_key", "_pii_hash", F.explode(found).alias("entity"))


def _words() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("_pii_text"), F.lit(TERM), F.lit(0)))


def disclosing_terms(
    docs: DataFrame, mentions: DataFrame, disclosure: float = DISCLOSURE, removal: float = REMOVAL, support: int = SUPPORT
) -> DataFrame:
    """``_pii_key, _pii_hash, term, removed``: the terms that reveal an entity, in the documents that hold both."""
    texts = mentions.groupBy("entity", "_pii_hash").agg(F.count("*").alias("n"))
    entities = texts.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("n_texts"))
    total = docs.count()
    # Most documents a term can stand in and still reach the ratio; the margin is for rounding.
    most = F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - disclosure)) * 1.000001
    entities = entities.filter((F.col("n_texts") >= support) & (F.col("n_e") < total)).select("entity", "n_e", most.alias("most"))
    entities = materialize(entities, "pii-entities")
    known = mentions.join(entities, "entity").select(F.col("_pii_key").alias("_pii_k"), F.col("_pii_hash").alias("_pii_h"), "entity", "n_e", "most")
    known = materialize(
        known.groupBy("_pii_k", "_pii_h").agg(
            F.collect_set(F.struct("entity", "n_e", "most")).alias("known"), F.max("most").alias("upto")
        ),
        "pii-known",
    )
    same = F.col("_pii_key").eqNullSafe(F.col("_pii_k")) & (F.col("_pii_hash") == F.col("_pii_h"))
    holding = docs.join(known.select("_pii_k", "_pii_h"), same, "left_semi")
    words = holding.select("_pii_key", "_pii_hash", F.explode(_words()).alias("term"))
    words = materialize(words, "pii-words")
    # Support first: few words are in enough texts that mention anything.
    wanted = words.groupBy("term").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= support)
    limit = entities.agg(F.max("most")).first()[0] or 0.0
    wanted = materialize(wanted.filter(F.col("n_near") <= limit).select("term"), "pii-wanted")
    counts = docs.select(F.explode(_words()).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = counts.filter(F.col("n_t") <= limit).join(wanted, "term", "left_semi")
    counts = materialize(counts, "pii-counts")
    held = words.join(counts, "term").join(known, same).filter(F.col("n_t") <= F.col("upto"))
    able = F.filter("known", lambda e: F.col("n_t") <= e["most"])
    pairs = held.select("_pii_key", "_pii_hash", "term", "n_t", F.explode(able).alias("e"))
    pairs = materialize(pairs.select("_pii_key", "_pii_hash", "term", "n_t", "e.entity", "e.n_e"), "pii-pairs")
    texts = pairs.groupBy("entity", "term", "_pii_hash").agg(F.count("*").alias("n"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    together = texts.groupBy("entity", "term").agg(
        F.sum("n").alias("n_et"), F.count("*").alias("n_texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")
    )
    given = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    ratio = given / F.log(F.lit(float(total)) / F.col("n_e"))
    found = together.filter(F.col("n_texts") >= support).select("entity", "term", ratio.alias("ratio"))
    found = found.filter(F.col("ratio") >= disclosure)
    found = found.select("entity", "term", (F.col("ratio") >= removal - 1e-9).alias("removed"))
    return pairs.join(materialize(found, "pii-found"), ["entity", "term"]).select("_pii_key", "_pii_hash", "term", "removed")


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        "*",
        F.col(key).alias("_pii_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_pii_text"),
        F.xxhash64(F.col(text)).alias("_pii_hash"),
    )


def spotted(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``_pii_text`` and the spans of every kind in ``_pii_<kind>``, terms included."""
    narrow = _prepared(docs.select(key, text), key, text).select("_pii_key", "_pii_hash", "_pii_text")
    mentions = materialize(_mentions(narrow), "pii-mentions")
    terms = disclosing_terms(narrow, mentions, **options)
    revealed = (
        terms.groupBy("_pii_key", "_pii_hash")
        .agg(
            F.sort_array(F.collect_set("term")).alias("_pii_terms"),
            F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("_pii_gone"),
        )
    )
    revealed = materialize(revealed, "pii-terms").withColumnsRenamed({"_pii_key": "_pii_k", "_pii_hash": "_pii_h"})
    given = _prepared(docs, key, text).join(
        revealed, F.col("_pii_key").eqNullSafe(F.col("_pii_k")) & (F.col("_pii_hash") == F.col("_pii_h")), "left"
    )
    found = with_spans(given)
    # The fixed kinds stand first in the pattern, so that no term is found inside one of their matches.
    fixed = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, CARD, IP))
    words = F.concat(
        F.lit(rf"{fixed}|(?iu)(?<![\p{{L}}\p{{N}}])(?:"), F.array_join("_pii_terms", "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    found = found.withColumn("_pii_pattern", words)
    hits = F.when(
        F.col("_pii_pattern").isNotNull(), F.regexp_extract_all("_pii_text", F.col("_pii_pattern"), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("_pii_hits", hits)
    found = found.withColumn("_pii_term", _located("_pii_text", "_pii_hits", F.col("_pii_pattern")))
    terms_only = F.filter("_pii_term", lambda t: t["value"].rlike(rf"^{TERM}$"))
    return found.withColumn("_pii_term", terms_only).drop("_pii_hits", "_pii_pattern", "_pii_k", "_pii_h")


def _listed(kinds: tuple[str, ...]) -> Column:
    """Spans of several kinds by start, then kind as listed."""

    def named(rank: int, kind: str):
        return lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["value"].alias("value"),
        )

    return F.sort_array(F.concat(*[F.transform(f"_pii_{k}", named(i, k)) for i, k in enumerate(kinds)]))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: counts and digest of the fixed kinds, and all spans."""
    found = spotted(docs.select(key, text), key, text, **options)
    return found.select(
        F.col(key),
        *[F.size(f"_pii_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(_listed(KINDS[:4])), 256).alias("base_sha256"),
        _joined(_listed(KINDS)).alias("spans"),
        F.size("_pii_term").cast("bigint").alias("n_term"),
    )


def sanitized(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced: ``[EMAIL]`` and so on, terms by ``[TERM]`` or by nothing."""
    found = spotted(docs, key, text, **options).withColumn("_pii_all", _listed(KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<struct<from:bigint,start:bigint,end:bigint,kind:string,value:string>>").alias("kept"))
    chosen = F.aggregate(
        "_pii_all",
        start,
        lambda a, s: F.when(
            s["start"] >= a["upto"],
            F.struct(
                s["end"].alias("upto"),
                F.concat(
                    a["kept"],
                    F.array(F.struct(a["upto"].alias("from"), s["start"], s["end"], s["kind"], s["value"])),
                ).alias("kept"),
            ),
        ).otherwise(a),
    )
    label = lambda s: F.when(
        (s["kind"] == "term") & F.array_contains("_pii_gone", F.lower(s["value"])), F.lit("")
    ).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    found = found.withColumn("_pii_chosen", F.when(F.size("_pii_all") > 0, chosen))
    pieces = F.transform(
        F.col("_pii_chosen.kept"),
        lambda s: F.concat(
            F.substring(F.col("_pii_text"), (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), label(s)
        ),
    )
    tail = F.substring(F.col("_pii_text"), (F.col("_pii_chosen.upto") + 1).cast("int"), F.lit(2147483647))
    clean = F.when(F.size("_pii_all") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(f"`{text}`"))
    return found.withColumn("_pii_clean", clean).select(
        *[F.col("_pii_clean").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )
