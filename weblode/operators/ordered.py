"""Order-dependent results without a single ordered task.

A running total over a whole table, or over one key that holds a third of it, would send all those
rows through one window partition.  Here the order column is cut into blocks: windows run inside
blocks, block summaries are carried forward the same way one level up, and the carried value is
joined back.  With ``BLOCK_BITS`` bits per level and unique, non-negative order values below
``2 ** (BLOCK_BITS * LEVELS)`` no window partition exceeds ``2 ** BLOCK_BITS`` rows, whatever the
key distribution.  Order values may be dense ids or epoch microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblode.session import materialize

BLOCK_BITS = 18
LEVELS = 3


def _group(keys: list[str], level: int, block: str) -> list[str]:
    return keys if level == LEVELS - 1 else [*keys, block]


def running_totals(df: DataFrame, order: str, measures: list[str], keys: list[str] | None = None) -> DataFrame:
    """Add ``<measure>_running``: the sum over this and all earlier rows (of the same ``keys``)."""
    return _running(df, order, measures, keys or [], 0)


def _running(df: DataFrame, order: str, measures: list[str], keys: list[str], level: int) -> DataFrame:
    block = f"_block{level}"
    group = _group(keys, level, block)
    blocked = df.withColumn(block, F.shiftright(F.col(order), BLOCK_BITS))
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.select("*", *[F.sum(m).over(upto).alias(f"{m}_running") for m in measures])
    if level == LEVELS - 1:
        return local.drop(block)
    sums = blocked.groupBy(*group).agg(*[F.sum(m).alias(m) for m in measures])
    before = _running(sums, block, measures, keys, level + 1).select(
        *[F.col(k).alias(f"_k_{k}") for k in group],
        *[(F.col(f"{m}_running") - F.col(m)).alias(f"_before_{m}") for m in measures],
    )
    joined = local.join(before, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group], "left")
    carried = {f"{m}_running": F.col(f"{m}_running") + F.col(f"_before_{m}") for m in measures}
    return joined.withColumns(carried).drop(block, *[f"_k_{k}" for k in group], *[f"_before_{m}" for m in measures])


def ordinals(df: DataFrame, order: str, name: str = "ordinal", keys: list[str] | None = None) -> DataFrame:
    """Add the 1-based position of each row in the order."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], keys)
    return counted.withColumnRenamed("_one_running", name).drop("_one")


def numbered_by(df: DataFrame, order: list, name: str = "seq") -> DataFrame:
    """Add increasing, unique numbers in the order of some columns, ready as an order column for the functions here.

    Range partitions are sorted each by itself; a row's number is its partition's and its place in it.  Written, so
    that the numbers stay what they are.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(name, F.monotonically_increasing_id()), "numbered")


def changes_so_far(df: DataFrame, keys: list[str], order: str, value: str, name: str = "changes") -> DataFrame:
    """Add ``name``: how often ``value`` changed between consecutive rows of a key, up to each row.

    A null key is a key of its own.  The first row of a key has 0; a null value counts as a change on
    both sides.
    """
    rows = df.withColumns({"_first": F.col(value), "_last": F.col(value), "_inside": F.lit(0).cast("bigint")})
    counted = _changes(rows, keys, order, 0)
    return counted.withColumnRenamed("_upto", name).drop("_first", "_last", "_inside")


def _changes(df: DataFrame, keys: list[str], order: str, level: int) -> DataFrame:
    # One element is a run of rows: its first and last value and the changes inside it.  ``_upto`` is
    # the number of changes before the element, the step into it included.
    block = f"_block{level}"
    group = _group(keys, level, block)
    blocked = df.withColumn(block, F.shiftright(F.col(order), BLOCK_BITS))
    w = Window.partitionBy(*group).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    same = F.coalesce(F.lag("_last").over(w) == F.col("_first"), F.lit(False))
    edge = F.when(F.lag(F.lit(1)).over(w).isNull() | same, 0).otherwise(1).cast("bigint")
    edged = blocked.withColumn("_edge", edge)
    local = edged.withColumn(
        "_upto", F.sum("_edge").over(upto) + F.coalesce(F.sum("_inside").over(earlier), F.lit(0))
    )
    if level == LEVELS - 1:
        return local.drop(block, "_edge")
    # The window left the rows partitioned by the group, so this aggregation adds no shuffle.
    summary = edged.groupBy(*group).agg(
        F.min_by("_first", order).alias("_first"),
        F.max_by("_last", order).alias("_last"),
        F.sum(F.col("_inside") + F.col("_edge")).alias("_inside"),
    )
    before = _changes(summary, keys, block, level + 1).select(
        *[F.col(k).alias(f"_k_{k}") for k in group], F.col("_upto").alias("_before")
    )
    joined = local.join(before, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group])
    return joined.withColumn("_upto", F.col("_upto") + F.col("_before")).drop(
        block, "_edge", "_before", *[f"_k_{k}" for k in group]
    )
