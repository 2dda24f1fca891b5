"""Mix sources to target weights by hash thresholds.

Every document has a hash; a source takes the documents whose hash lies below its threshold.  The threshold is
found without sorting documents: tokens are summed per source and leading hash bits, the bucket in which the
running total passes the budget is the boundary bucket, and only its documents are counted again by their next
bits.  Budgets nest: a source that may take more than all it has takes everything ``floor(target / size)`` times
and applies the threshold to the rest, so the documents of a later pass are a subset of the earlier one's.

Defined cases.  A null text has size 0 and is taken 0 words.  A null source is a source of its own, ranked last.
Rows equal in id and text share a hash and are taken together; so are documents that agree in all hash bits
looked at (36), where the nearer of taking all or none is chosen.  An empty table gives an empty result.  Columns
of the input may have any names: working columns start with ``_mix_`` and are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.llm.common import word_count
from weblode.session import materialize

BITS = 12
LEVELS = 3
SALT = 20_011


def _bits(level: int) -> Column:
    """The hash bits of one level, most significant first."""
    return F.shiftrightunsigned(F.col("_mix_hash"), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def _hashed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(
        "*",
        F.col(source).alias("_mix_source"),
        word_count(F.col(text)).alias("_mix_size"),
        F.xxhash64(F.lit(SALT), F.col(key), F.col(text)).alias("_mix_hash"),
    )


def ranked_sources(sized: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row per source: size and weight, weights repeating in code point order with null last.

    The rank is the position within a range-partitioned table plus the number of sources in earlier partitions,
    so no task holds all sources.
    """
    sources = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"))
    order = F.col("_mix_source").asc_nulls_last()
    ranged = materialize(
        sources.repartitionByRange(order).withColumn("_mix_part", F.spark_partition_id()), "mix-sources"
    )
    parts = ranged.groupBy("_mix_part").agg(F.count("*").alias("_mix_rows"))
    # One row per partition of the range shuffle: a bounded window.
    before = parts.select(
        "_mix_part",
        (F.sum("_mix_rows").over(Window.orderBy("_mix_part")) - F.col("_mix_rows")).alias("_mix_before"),
    )
    local = F.row_number().over(Window.partitionBy("_mix_part").orderBy(order)) - 1
    rank = (F.col("_mix_before") + F.col("_mix_local")) % len(weights)
    return (
        ranged.withColumn("_mix_local", local)
        .join(before, "_mix_part")
        .select("_mix_source", "_mix_total", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).alias("_mix_weight"))
    )


def targets(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """Add ``_mix_target``: ``share`` of all sizes by weight, none above ``limit`` times its source's size.

    Sources above their limit are fixed there and the rest reshared, until none is above.  Each round is one
    aggregation to a single row.
    """
    size, weight = F.col("_mix_total").cast("double"), F.col("_mix_weight").cast("double")
    total = sources.agg(F.sum(size), F.sum(weight)).first()
    if not total[0]:
        return sources.withColumn("_mix_target", F.lit(0.0))
    rate, fixed = share * total[0] / total[1], -1
    while True:
        above = limit * size <= F.lit(rate) * weight
        now = sources.agg(
            F.count_if(above), F.sum(F.when(above, limit * size)), F.sum(F.when(~above, weight))
        ).first()
        if now[0] == fixed or not now[2]:
            break
        fixed, rate = now[0], (share * total[0] - (now[1] or 0.0)) / now[2]
    return sources.withColumn("_mix_target", F.least(limit * size, F.lit(rate) * weight))


def _thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Add to each source ``_mix_full``, and the boundary ``_mix_cut`` below which one more pass is taken."""
    full = F.coalesce(F.floor(F.try_divide("_mix_target", "_mix_total")), F.lit(0)).cast("bigint")
    state = sources.withColumn("_mix_full", full).withColumns(
        {
            "_mix_budget": F.col("_mix_target") - F.col("_mix_full") * F.col("_mix_total"),
            "_mix_prefix": F.lit(0).cast("bigint"),
        }
    )
    keep = state.columns
    running = Window.partitionBy("_mix_source", "_mix_prefix").orderBy("_mix_bucket")
    for level in range(LEVELS):
        # Rows whose leading bits equal the source's boundary so far: all of them at first, one bucket's after.
        lead = F.lit(0).cast("bigint") if level == 0 else F.shiftrightunsigned(F.col("_mix_hash"), 64 - BITS * level)
        histogram = sized.groupBy("_mix_source", lead.alias("_mix_lead"), _bits(level).alias("_mix_bucket"))
        if level:
            edge = state.select(F.col("_mix_source").alias("_mix_s"), F.col("_mix_prefix").alias("_mix_p"))
            inside = sized.join(
                edge, sized["_mix_source"].eqNullSafe(F.col("_mix_s")) & (lead == F.col("_mix_p")), "left_semi"
            )
            histogram = inside.groupBy("_mix_source", lead.alias("_mix_lead"), _bits(level).alias("_mix_bucket"))
        sums = histogram.agg(F.sum("_mix_size").alias("_mix_sum"))
        sums = sums.select(F.col("_mix_source").alias("_mix_s"), "_mix_lead", "_mix_bucket", "_mix_sum")
        joined = state.join(
            sums, F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_prefix") == F.col("_mix_lead"))
        )
        passed = joined.withColumn("_mix_upto", F.sum("_mix_sum").over(running))
        boundary = passed.filter(
            (F.col("_mix_upto") > F.col("_mix_budget"))
            & (F.col("_mix_upto") - F.col("_mix_sum") <= F.col("_mix_budget"))
            & (F.col("_mix_sum") > 0)
        )
        state = materialize(
            boundary.withColumns(
                {
                    "_mix_budget": F.col("_mix_budget") - (F.col("_mix_upto") - F.col("_mix_sum")),
                    "_mix_prefix": F.col("_mix_prefix") * (1 << BITS) + F.col("_mix_bucket"),
                    "_mix_cell": F.col("_mix_sum"),
                }
            ).select(*keep, "_mix_cell"),
            "mix-boundary",
        )
    # The last cell goes whole to the nearer side.
    return state.select(
        "_mix_source", (F.col("_mix_prefix") + (F.col("_mix_budget") * 2 >= F.col("_mix_cell")).cast("bigint")).alias("_mix_cut")
    )


def mixture(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow measures, and one row per source with its size, target and threshold."""
    sized = materialize(
        _hashed(docs.select(key, text, source), key, text, source).select(
            F.col(key).alias("_mix_key"), "_mix_source", "_mix_size", "_mix_hash"
        ),
        "mix-sizes",
    )
    sources = materialize(targets(ranked_sources(sized, weights), share, limit), "mix-targets")
    cuts = _thresholds(sized, sources).withColumnRenamed("_mix_source", "_mix_s")
    full = F.coalesce(F.floor(F.try_divide("_mix_target", "_mix_total")), F.lit(0)).cast("bigint")
    plan = sources.join(cuts, F.col("_mix_source").eqNullSafe(F.col("_mix_s")), "left").select(
        F.col("_mix_source").alias("_mix_of"),
        "_mix_total",
        "_mix_target",
        full.alias("_mix_full"),
        F.coalesce(F.col("_mix_cut"), F.lit(0)).alias("_mix_cut"),
    )
    return sized, materialize(plan, "mix-plan")


def with_copies(hashed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``_mix_copies``: how often each row is taken, by its source's threshold."""
    under = F.shiftrightunsigned(F.col("_mix_hash"), 64 - BITS * LEVELS) < F.col("_mix_cut")
    joined = hashed.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
    return joined.withColumn("_mix_copies", F.col("_mix_full") + under.cast("bigint"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    sized, plan = mixture(docs, **options)
    return with_copies(sized, plan).select(
        F.col("_mix_key").alias(options.get("key", "doc_id")),
        F.col("_mix_size").alias("size"),
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns of ``docs``."""
    _, plan = mixture(docs, **options)
    names = [options.get(k, k if k != "key" else "doc_id") for k in ("key", "text", "source")]
    taken = with_copies(_hashed(docs, *names), plan).filter("_mix_copies > 0")
    return taken.withColumn("_mix_pass", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
