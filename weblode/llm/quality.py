"""Quality rules with verdicts by host.

Each document is measured and checked against rules.  Failures are summed by host (the domain of a document, here
its source) and rule; a host's failure rate is shrunk towards the rate of all hosts with a beta prior whose mean and
strength come from the hosts themselves (method of moments), so a host of few documents is not judged by one of
them.  A host is distrusted for a rule when its shrunken rate passes the rule's limit, and then its documents that
fail the rule are rejected; elsewhere a single soft failure is forgiven.  Hard rules reject anywhere.

Defined cases.  A null text has no words and fails the hard rule on length.  A null host is a host of its own.
Rows that repeat a document count and are judged each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.session import materialize

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Soft rules: share of a document above which the rule fails.
SYMBOLS_PER_WORD = 0.1
DUPLICATE_LINES = 0.3
WORD_LENGTH = (2.0, 20.0)
#: A host is distrusted for a rule from this shrunken failure rate on.
HOST_LIMIT = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SOFT = ("symbols", "lines", "length")
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words lying in a window of so many words that occurs twice or more, its first occurrence included."""
    grams = list(zip(*[words[i:] for i in range(window)], strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = upto = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(upto, i)
            upto = i + window
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The measures of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly space and tab to carriage return
    seen, duplicates = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line.strip():
                if line in seen:
                    duplicates += 1
                seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        duplicates,
        repeated_words(words),
    )


def measured(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Narrow table of ``_key, _host`` and the measures."""
    kinds = dict(docs.dtypes)
    fields = f"_key {kinds[key]}, _host {kinds[host]}, n_lines bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [measure(t) for t in batch["_text"]]
            frame = pd.DataFrame(values, columns=list(MEASURES), dtype="int64")
            for name in ("_key", "_host", "n_lines"):
                frame[name] = batch[name].values
            yield frame[["_key", "_host", "n_lines", *MEASURES]]

    text_col = F.col(text)
    given = docs.select(
        F.col(key).alias("_key"),
        F.col(host).alias("_host"),
        _line_count(text_col).alias("n_lines"),
        text_col.alias("_text"),
    )
    # Ids may be null; pandas would turn them into floats, so they travel as strings and come back typed.
    as_text = given.withColumn("_key", F.col("_key").cast("string"))
    out = as_text.mapInPandas(run, fields.replace(f"_key {kinds[key]}", "_key string"))
    return out.withColumn("_key", F.col("_key").cast(kinds[key]))


def failures() -> dict[str, Column]:
    """The soft rules as columns over the measures."""
    words, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") > SYMBOLS_PER_WORD * words,
        "lines": F.col("n_dup_lines") > DUPLICATE_LINES * F.col("n_lines"),
        "length": ~mean.between(*WORD_LENGTH),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: ``_host`` and per rule its shrunken failure rate and ``bad_<rule>``.

    Prior per rule by the method of moments over hosts: with mean m and variance v of the hosts' rates, the strength
    is m(1-m)/v - 1, kept at least 1.  Prior and rates are aggregations; the prior is a single row.
    """
    hosts = rows.groupBy("_host").agg(
        F.count("*").alias("_n"), *[F.count_if(c).alias(f"_f_{r}") for r, c in failures().items()]
    )
    hosts = materialize(hosts, "quality-hosts")
    prior = hosts.agg(
        *[
            x
            for r in SOFT
            for x in (
                F.avg(F.col(f"_f_{r}") / F.col("_n")).alias(f"m_{r}"),
                F.var_pop(F.col(f"_f_{r}") / F.col("_n")).alias(f"v_{r}"),
            )
        ]
    ).first()
    found = hosts
    for r in SOFT:
        mean, spread = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else 1.0
        rate = (F.col(f"_f_{r}") + mean * strength) / (F.col("_n") + strength)
        found = found.withColumns({f"rate_{r}": rate, f"bad_{r}": rate > limit})
    return found.select("_host", *[f"rate_{r}" for r in SOFT], *[f"bad_{r}" for r in SOFT])


def _verdicts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    rows = materialize(measured(docs.select(key, text, host), key, text, host), "quality-measures")
    verdicts = host_verdicts(rows).withColumnRenamed("_host", "_of")
    hit = F.lit(False)
    for r, c in failures().items():
        hit = hit | (c & F.col(f"bad_{r}"))
    joined = rows.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~hit})


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: ``key``, the measures, ``base_failed``, ``kept`` and its host's rates."""
    return _verdicts(docs, key, text, host).select(
        F.col("_key").alias(key), *MEASURES, "base_failed", "kept", *[f"rate_{r}" for r in SOFT]
    )


def passing(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are measured once for the verdicts of hosts and once more where they pass: only the few measures leave a
    text's task, so the documents themselves are never shuffled for it.
    """
    rows = materialize(measured(docs.select(key, text, host), key, text, host), "quality-measures")
    verdicts = host_verdicts(rows)
    verdicts = materialize(verdicts.select("_host", *[f"bad_{r}" for r in SOFT]), "quality-verdicts")
    value = _measured_again(docs[f"`{text}`"])
    lines = _line_count(docs[f"`{text}`"])
    given = docs.select(F.struct("*").alias("_row"), docs[f"`{host}`"].alias("_of"), value.alias("_m"), lines.alias("n_lines"))
    given = given.select("_row", "_of", "n_lines", *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    joined = given.join(verdicts, F.col("_of").eqNullSafe(F.col("_host")))
    hit = F.lit(False)
    for r, c in failures().items():
        hit = hit | (c & F.col(f"bad_{r}"))
    return joined.filter(~base_failed() & ~hit).select("_row.*")


def _line_count(text: Column) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.coalesce(lines, F.lit(0)).cast("bigint")


_MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.pandas_udf(_MEASURED)
def _measured_again(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")
