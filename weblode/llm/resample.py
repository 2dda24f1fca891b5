"""Draw the documents most like a target collection: importance resampling over hashed word runs.

Texts stay in Arrow: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the words of a batch,
``dictionary_encode`` numbers the different ones.  Runs of several words are pairs of a shorter run's number and the
next word's number, taken by shifting the number array; a CRC is computed once per different run.  The features'
gains are taken by bucket and summed over each document's segment.

Counts: each task adds up its features in one vector of ``buckets`` numbers, so a task sends at most that many rows,
whatever its size.  The gains of all buckets, ``buckets`` numbers, go to every task.  Drawing: scores are integers
within about 1000 * (ln of all features + 23) of zero, so their histogram is small; it gives the lowest score drawn,
and only rows at or above it are sorted, by ranges.

Defined cases.  A null text has no words.  A text without features weighs 0.  A null id hashes like an empty one and
comes last among equal scores; repeated rows are drawn one by one.  Without target texts every gain still has its
smoothed value.  An empty table gives an empty result.  Extra columns of the input are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.session import materialize

#: What stands between words: ASCII other than letters and digits, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text whose words are held at a time.
SLICE = 8 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in stretches of about ``SLICE`` bytes, so that memory follows neither batch nor text sizes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield texts.slice(start, end - start)
        start = end


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text; and per run length the texts' numbers and buckets of all runs, in order of the texts."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.ascii_lower(texts), ""), pattern=BETWEEN)
    words, owners = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(words, "")
    words, owner = words.filter(there), owners.filter(there).to_numpy().astype(np.int64)
    encoded = words.dictionary_encode()
    number = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in encoded.dictionary.to_pylist()]
    crcs = np.fromiter((zlib.crc32(w) for w in spelled), np.int64, len(spelled))
    runs, codes = [(owner, crcs[number] % buckets)], number
    for length in range(2, longest + 1):
        # A run and its next word, if the same text holds both.
        pairs = codes[:-1] * len(spelled) + number[length - 1 :]
        inside = owner[: len(pairs)] == owner[length - 1 :]
        distinct, back = np.unique(pairs, return_inverse=True)
        first, last = np.divmod(distinct, max(1, len(spelled)))
        crcs = np.fromiter(
            (zlib.crc32(spelled[b], zlib.crc32(b" ", int(crcs[a]))) for a, b in zip(first, last)), np.int64, len(distinct)
        )
        codes = back.reshape(-1)
        runs.append((owner[: len(pairs)][inside], crcs[codes][inside] % buckets))
    return np.bincount(owner, minlength=len(texts)), runs


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """``bucket, n``: features of all texts by bucket; only buckets that have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for _, bucket in features(part, longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """The gain of every bucket: how much likelier the target holds its features, smoothed, in thousandths."""
    counts = []
    for frame in (docs, target):
        # At most ``buckets`` rows.
        found = bucket_counts(frame, text, longest, buckets).toPandas()
        counts.append(np.bincount(found["bucket"].astype(int), found["n"], buckets).astype(np.int64).tolist())
    raw, wanted = counts
    all_raw, all_wanted = sum(raw), sum(wanted)
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * float(all_raw + buckets) / (float(s + 1) * float(all_wanted + buckets))))
            for s, t in zip(raw, wanted)
        ],
        np.int64,
    )


def scored(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight, score``.

    ``weight`` is the floored mean of its features' gains; ``score`` adds Gumbel noise that depends on seed and id only,
    so the highest scores are a sample without replacement by weight.
    """
    gains = bucket_gains(docs, target, text, longest, buckets)

    @F.arrow_udf("struct<n_words bigint, n_features bigint, weight bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, 3), np.int64)]
        for part in slices(texts):
            n_words, runs = features(part, longest, buckets)
            n, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for owner, bucket in runs:
                # Owners ascend: each text's gains are one segment.
                ends = np.searchsorted(owner, np.arange(len(part)), "right")
                upto = np.concatenate([[0], np.cumsum(gains.take(bucket))])
                total += np.diff(upto[ends], prepend=0)
                n += np.diff(ends, prepend=0)
            out.append(np.stack([n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)], 1))
        table = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], ["n_words", "n_features", "weight"])

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    weighed = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).select(
        "doc_id", weigh("t").alias("w"), F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint").alias("h")
    )
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0))))
    return weighed.select("doc_id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + noise).alias("score"))


def drawn(scores: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Add ``rank``: 1, 2, 3... for the highest scores among documents of ``least_words`` words, null for the rest.

    ``percent`` of a hundred such documents are drawn; equal scores go by smaller id.
    """
    # A row's number settles ties of repeated rows, and spreads them over range partitions.
    rows = materialize(scores.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    able = F.col("n_words") >= least_words
    # One row per different score; scores are bounded integers (see above).
    histogram = rows.filter(able).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    wanted = percent * int(histogram["count"].sum()) // 100
    plain = rows.withColumn("rank", F.lit(None).cast("bigint")).drop("row")
    if not wanted:
        return plain
    edge = int(histogram["score"].iloc[int(np.searchsorted(histogram["count"].cumsum(), wanted))])
    above = able & (F.col("score") >= edge)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    # In a sorted partition the increasing id is the partition's number, then the place in it.
    placed = rows.filter(above).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33)),
        "resample-order",
    )
    # One row per range partition, each with tens of thousands of documents.
    sizes = placed.groupBy("part").count().toPandas().sort_values("part")
    starts = list(zip(sizes["part"].tolist(), (sizes["count"].cumsum() - sizes["count"]).tolist()))
    before = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(before, "part").withColumn("rank", F.when(rank <= wanted, rank))
    return plain.filter(~above).unionByName(ranked.select(plain.columns))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """Per document: ``doc_id, n_features, weight, score, rank``."""
    return drawn(scored(docs, target, **options), percent, least_words).drop("n_words")
