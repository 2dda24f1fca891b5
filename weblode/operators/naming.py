"""File names for downloads: sanitised and made unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.functions.text import sanitize_filename, split_name
from weblode.operators.ordered import ordinals, running_totals
from weblode.session import materialize


def collision_names(files: DataFrame, order: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """Add ``safe_name``, ``collision`` (0 for the first of a name) and ``saved_name`` (``name_1.ext``, ...).

    Plain numbering per name; :func:`unique_names` also avoids names that exist already.
    """
    safe = files.withColumn("safe_name", sanitize_filename(F.col("filename")))
    numbered = ordinals(safe, order, "_n", [*(scope or []), "safe_name"])
    stem, suffix = split_name(F.col("safe_name"))
    numbered = numbered.withColumn("collision", F.col("_n") - 1).drop("_n")
    renamed = F.concat(stem, F.lit("_"), F.col("collision").cast("string"), suffix)
    return numbered.withColumn(
        "saved_name", F.when(F.col("collision") == 0, F.col("safe_name")).otherwise(renamed)
    )


def unique_names(files: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Add ``saved_name``: ``name``, ``name_1``, ``name_2``, ... so that no two files share one.

    Names in ``existing`` (``saved_name``, the folder's content) are passed over, and a number is
    never used when the name it gives is another file's own plain name.  The k-th file of a name gets
    its k-th free number.  With the taken numbers ``t_1 < t_2 < ...`` there are ``t_i - (i - 1)``
    free numbers below ``t_i``, so the k-th free number is ``k - 1`` plus the count of ``i`` with
    ``t_i - (i - 1) <= k - 1``: a running count over files and taken numbers merged in one order,
    not a loop over names.
    """
    safe = files.withColumn("safe_name", sanitize_filename(F.col("filename")))
    turned = ordinals(safe, order, "_rank", ["safe_name"]).withColumn("_rank", F.col("_rank") - 1)
    turned = materialize(turned, "names-turned")
    stem, suffix = split_name(F.col("safe_name"))

    # Names that look numbered, as (family, number); the plain name of a family has number 0.
    plain = turned.select(F.col("safe_name").alias("saved_name")).distinct()
    occupied = plain.withColumn("_own", F.lit(True))
    if existing is not None:
        there = existing.select("saved_name").distinct()
        occupied = occupied.unionByName(there.withColumn("_own", F.lit(False)))
    head, tail = split_name(F.col("saved_name"))
    number = F.regexp_extract(head, r"_([1-9][0-9]*)$", 1)
    numbered = occupied.filter(number != "").select(
        F.concat(F.regexp_replace(head, r"_[1-9][0-9]*$", ""), tail).alias("safe_name"),
        # A number beyond any count of files can't be given out, so it needs no place among the taken ones.
        number.try_cast("bigint").alias("_taken"),
    ).filter(F.col("_taken") < 2**52)
    if existing is not None:
        numbered = numbered.unionByName(
            there.select(F.col("saved_name").alias("safe_name"), F.lit(0).cast("bigint").alias("_taken"))
        )
    taken = numbered.distinct().join(plain.withColumnRenamed("saved_name", "safe_name"), "safe_name", "left_semi")
    gaps = ordinals(taken, "_taken", "_i", ["safe_name"]).select(
        "safe_name", (F.col("_taken") - (F.col("_i") - 1)).alias("_rank"), F.lit(1).cast("bigint").alias("_gap")
    )
    # Several taken numbers can share a gap position; as counts they are one row each.
    gaps = materialize(gaps.groupBy("safe_name", "_rank").agg(F.sum("_gap").alias("_gap")), "names-gaps")
    # In the merged order a gap precedes the file of equal rank.
    merged = turned.withColumn("_gap", F.lit(0).cast("bigint")).withColumn("_at", F.col("_rank") * 2 + 1)
    merged = merged.unionByName(gaps.withColumn("_at", F.col("_rank") * 2), allowMissingColumns=True)
    counted = running_totals(merged, "_at", ["_gap"], ["safe_name"]).filter(F.col(order).isNotNull())
    free = F.col("_rank") + F.col("_gap_running")
    renamed = F.concat(stem, F.lit("_"), free.cast("string"), suffix)
    return counted.withColumn(
        "saved_name", F.when(free == 0, F.col("safe_name")).otherwise(renamed)
    ).select(*safe.columns, "saved_name")
