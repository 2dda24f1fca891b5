"""Passages that repeat across documents, found at sparse places of their suffixes.

Of all word suffixes of the corpus only those at content-selected places are looked at: the minimisers, places whose
hash of the next ``GRAM`` words is smallest among ``WINDOW`` neighbours.  Equal passages of ``MIN_WORDS`` words select
equal places, so a window of that many words can recur only if all places chosen within it do.  The windows left are
hashed whole, and those that stand in two documents are marked; overlapping marks of a document are merged.  Every
window is judged by the smallest and largest document of its hash, counted before the shuffle, so nothing depends on
how often a passage or a part of it is repeated.

Windows are equal if their 64-bit hashes are.

Defined cases.  Null, empty and short texts have no passages.  Rows of equal id are one document, whose passages
must recur under another id; a null id is an id of its own.  What repeats only inside one document is not reported.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblode.llm.neardup import WordHashes
from weblode.session import materialize

MIN_WORDS = 50
GRAM = 10
WINDOW = MIN_WORDS - GRAM + 1 - 9
#: Windows a task holds before it gives them out.
ROWS_AT_ONCE = 200_000
NO_ID = -(2**63)

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def word_values(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def gram_values(values: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` words from each place."""
    n = len(values) - GRAM + 1
    total = np.zeros(n, np.uint64)
    for i in range(GRAM):
        total = (total + values[i : i + n]) * _MULTIPLY
        total ^= total >> np.uint64(29)
    return total


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Places whose gram is the smallest of some window of ``WINDOW`` grams."""
    low = _sliding(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    bound = _sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum)
    return np.flatnonzero(grams == bound)


def window_values(values: np.ndarray) -> np.ndarray:
    """Hashes of the ``MIN_WORDS`` words from each place, by doubling."""
    n = len(values) - MIN_WORDS + 1
    total, block, at, width = np.zeros(n, np.uint64), values, 0, 1
    while width <= MIN_WORDS:
        if MIN_WORDS & width:
            total = _stirred(total * _MULTIPLY + block[at : at + n])
            at += width
        block = _stirred(block[:-width] * _MULTIPLY + block[width:]) if 2 * width <= MIN_WORDS else block
        width *= 2
    return total


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def candidates(grams: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Starts of the windows of ``MIN_WORDS`` words whose chosen grams are all among ``keys``."""
    known = np.isin(_sliding(grams, WINDOW, np.minimum), keys)
    return np.flatnonzero(_sliding(known, MIN_WORDS - GRAM - WINDOW + 2, np.minimum))


def _keys(docs: DataFrame) -> DataFrame:
    """``key, doc`` of each minimiser, once per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            keys, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                values = word_values(text, hashes)
                if len(values) >= MIN_WORDS:
                    grams = gram_values(values)
                    found = np.unique(grams[minimisers(grams)])
                    keys.append(found)
                    names.append(np.full(len(found), doc, np.int64))
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc": np.concatenate(names)})

    return docs.mapInPandas(run, "key bigint, doc bigint")


def _windows(docs: DataFrame) -> DataFrame:
    """``window, doc, start`` of ``doc, text, keys``: the windows that can recur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        out: list[tuple[np.ndarray, int, np.ndarray]] = []

        def flushed() -> pd.DataFrame:
            sizes = [len(at) for _, _, at in out]
            names = np.repeat(np.array([doc for _, doc, _ in out], np.int64), sizes)
            frame = pd.DataFrame({"window": np.concatenate([w for w, _, _ in out]), "doc": names, "start": np.concatenate([at for _, _, at in out])})
            out.clear()
            return frame

        for batch in batches:
            for doc, text, keys in zip(batch["doc"], batch["text"], batch["keys"], strict=True):
                values = word_values(text, hashes)
                if len(values) < MIN_WORDS:
                    continue
                at = candidates(gram_values(values), np.asarray(keys, np.int64).view(np.uint64))
                if len(at):
                    out.append((window_values(values)[at].view(np.int64), doc, at))
                if len(out) == 200 or (out and len(out[-1][2]) > ROWS_AT_ONCE):
                    yield flushed()
            if out:
                yield flushed()

    return docs.mapInPandas(run, "window bigint, doc bigint, start int")


def _marks(windows: DataFrame) -> DataFrame:
    """``doc, start, end, other`` of the windows that stand in two documents."""
    both = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b")
    hit = windows.join(materialize(both, "suffix-both"), "window")
    other = F.when(F.col("doc") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    each = hit.select("doc", "start", other.alias("other")).repartition("doc")
    return each.groupBy("doc", "start").agg(F.min("other").alias("other")).select(
        "doc", "start", (F.col("start") + MIN_WORDS).alias("end"), "other"
    )


def merged(marks: DataFrame) -> DataFrame:
    """Overlapping marks of a document as one: ``doc, start, end, other``."""
    order = Window.partitionBy("doc").orderBy("start", "end", "other")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = marks.withColumn("_new", (before.isNull() | (F.col("start") > before)).cast("int"))
    numbered = begun.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")
    )


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_word, end_word, n_words, other_id``: passages that another document holds too.

    ``other_id`` is one such document; words are counted from 0, the end exclusive.
    """
    given = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    keys = materialize(_keys(given), "suffix-keys")
    repeated = keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("key")
    wanted = keys.join(materialize(repeated, "suffix-repeated"), "key", "left_semi")
    wanted = wanted.groupBy(F.col("doc").alias("of")).agg(F.collect_set("key").alias("keys"))
    held = given.join(materialize(wanted, "suffix-wanted"), F.col("doc") == F.col("of")).select("doc", "text", "keys")
    # One document can be several rows; the same place of the same text is marked once.
    marks = _marks(materialize(_windows(held), "suffix-windows"))
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return merged(marks).select(
        name("doc").alias(key),
        F.col("start").cast("bigint").alias("start_word"),
        F.col("end").cast("bigint").alias("end_word"),
        (F.col("end") - F.col("start")).cast("bigint").alias("n_words"),
        name("other").alias("other_id"),
    )
