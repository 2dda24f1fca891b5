"""First-wins removal of repeated documents by URL and by file name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblode.operators.groups import connected
from weblode.session import materialize

#: Rows of a connected group that one task goes through in order.
GROUP_ROWS = 200_000


def dedup_by_name(documents: DataFrame, order: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """Keep the first document of each file name (ignoring case) where the name follows from the URL.

    Returns one row per kept document with ``skipped``: the later rows with that name but another
    URL.  Rows repeating the kept URL are dropped silently.  Only mergeable aggregates are used: rows
    are first combined per (name, URL), so a hot name or URL shrinks before it moves.
    """
    scope = scope or []
    named = documents.withColumn("_name", F.lower("filename"))
    per_url = named.groupBy(*scope, "_name", "url").agg(
        F.min_by(F.struct(*documents.columns), order).alias("_row"),
        F.min(order).alias("_first"),
        F.count("*").alias("_n"),
    )
    per_name = per_url.groupBy(*scope, "_name").agg(
        F.min_by("_row", "_first").alias("_row"),
        (F.sum("_n") - F.min_by("_n", "_first")).alias("skipped"),
    )
    return per_name.select("_row.*", "skipped")


def dedup_two_key(documents: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Exact first-wins dedup when a file name need not follow from the URL.

    In order, a document is dropped if its URL was kept before, else dropped *and counted* if its
    file name was, else kept.  Returns ``(kept, counted)``.

    A row that is the earliest left for both its URL and its name must be kept, and then decides all rows sharing
    either.  One round of that rule settles nearly everything.  What is left is split into groups connected by URLs and
    names: groups of up to ``GROUP_ROWS`` rows are gone through in order, all in one pass, however long their chains
    are; larger ones in stretches of the order, all at once, what is open between stretches being settled afterwards.
    """
    rows = documents.withColumns({"_name": F.lower("filename"), "_row": F.monotonically_increasing_id()})
    left = materialize(rows, "dedup-open")
    schema = documents.columns
    kept_parts: list[DataFrame] = []
    if not left.isEmpty():
        kept, left = _round(left, order)
        kept_parts.append(kept)
    if not left.isEmpty():
        kept, left = _in_order(left, order)
        kept_parts.append(kept)
    step = _in_stretches
    while not left.isEmpty():
        kept, left = step(left, order)
        kept_parts.append(kept)
        step = _round if step is _in_stretches else _in_stretches
    if not kept_parts:
        return documents, documents.limit(0)
    all_kept = kept_parts[0]
    for part in kept_parts[1:]:
        all_kept = all_kept.unionByName(part)
    dropped = documents.withColumn("_name", F.lower("filename")).join(all_kept.select(order), order, "left_anti")
    same_url = all_kept.select("url", F.col(order).alias("_url_at"))
    same_name = all_kept.select("_name", F.col(order).alias("_name_at"))
    judged = dropped.join(same_url, "url", "left").join(same_name, "_name", "left")
    silent = F.coalesce(F.col("_url_at") < F.col(order), F.lit(False))
    counted = judged.filter(~silent & (F.col("_name_at") < F.col(order)))
    return all_kept.select(*schema), counted.select(*schema)


def _round(left: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are the earliest for both their URL and their name, and the rows that share neither with them."""
    first_by_url = left.groupBy("url").agg(F.min(order).alias("_by_url"))
    first_by_name = left.groupBy("_name").agg(F.min(order).alias("_by_name"))
    # A row is kept when it is the minimum on both sides: join the two minima tables on it.
    kept_keys = first_by_url.join(first_by_name, F.col("_by_url") == F.col("_by_name")).select(F.col("_by_url").alias(order))
    kept = materialize(left.join(kept_keys, order, "left_semi"), "dedup-kept")
    rest = left.join(kept.select("url"), "url", "left_anti").join(kept.select("_name"), "_name", "left_anti")
    return kept, materialize(rest, "dedup-open")


def _in_order(left: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept in groups small enough to go through in order, and all rows of larger groups."""
    # Values whose hashes are equal only make a group larger.
    ends = left.select("_row", F.xxhash64(F.lit("u"), "url").alias("a"), F.xxhash64(F.lit("n"), "_name").alias("b"))
    roots = connected(ends)
    grouped = left.join(ends.select("_row", "a"), "_row").join(roots, F.col("a") == F.col("node")).withColumnRenamed("root", "_group")
    sizes = materialize(grouped.groupBy("_group").agg(F.count("*").alias("_rows")), "dedup-groups")
    small = grouped.join(sizes.filter(F.col("_rows") <= GROUP_ROWS), "_group", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, urls, names = None, set(), set()
        for batch in batches:
            kept = []
            for row, own, url, name in zip(batch["_row"], batch["_group"], batch["url"], batch["_name"], strict=True):
                if own != group:
                    group, urls, names = own, set(), set()
                if url not in urls and name not in names:
                    urls.add(url)
                    names.add(name)
                    kept.append(row)
            yield pd.DataFrame({"_row": kept}, dtype="int64")

    walked = small.repartition("_group").sortWithinPartitions("_group", order).select("_row", "_group", "url", "_name")
    chosen = walked.mapInPandas(run, "_row bigint")
    kept = materialize(left.join(chosen, "_row", "left_semi"), "dedup-kept")
    large = sizes.filter(F.col("_rows") > GROUP_ROWS)
    return kept, materialize(grouped.join(large, "_group", "left_semi").select(left.columns), "dedup-open")


#: Of a walk through stretches: a row's fate (``_row``), or what a stretch leaves of a value shared with others.  ``value``
#: is 1 (kept, used), 0, OPEN, or LIKE: as the value ``on`` before the stretch, or its opposite.
_FATE = "_row bigint, stretch int, kind string, key string, value int, on_kind string, on_key string, negated boolean"
OPEN, LIKE = 2, 3


def _in_stretches(left: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept of groups of any size, and the rows that stay open.

    The order is cut into stretches of about ``GROUP_ROWS`` rows, a task each.  Whether a URL or name was used before a
    stretch is not known in it, so a row is kept, dropped, or kept just if one such value was used, or was not.  Where
    stretches hang together by single values, as in chains, joining what each makes of the one before settles all rows,
    in as many steps as the number of stretches has binary digits.  A row that hangs on two such values stays open, and
    what hangs on it; the first stretch never is.
    """
    stretches = max(1, -(-left.count() // GROUP_ROWS))
    dealt = materialize(left.repartitionByRange(stretches, order).withColumn("_stretch", F.spark_partition_id()), "dedup-stretches")
    rows = dealt.select("_row", "_stretch", order, "url", "_name")
    for value, name in (("url", "_of_url"), ("_name", "_of_name")):
        spans = dealt.groupBy(value).agg(F.struct(F.min("_stretch").alias("first"), F.max("_stretch").alias("last")).alias(name))
        rows = rows.join(spans, value)
    rows = rows.select(
        "_row", "_stretch", order, "url", "_name",
        *[(F.col(f"{s}.first") < F.col("_stretch")).alias(f"{s}_met") for s in ("_of_url", "_of_name")],
        *[(F.col(f"{s}.first") < F.col(f"{s}.last")).alias(f"{s}_shared") for s in ("_of_url", "_of_name")],
    )
    walked = rows.repartition(stretches, "_stretch").sortWithinPartitions("_stretch", order).drop(order)
    fates = materialize(walked.mapInPandas(_walk, _FATE), "dedup-fates")
    # What a stretch leaves of a value is what the next one with it meets.
    turn = Window.partitionBy("kind", "key").orderBy("stretch")
    left_over = fates.filter("_row IS NULL").withColumn("at", F.lead("stretch").over(turn)).filter("at IS NOT NULL")
    met = materialize(left_over.select("kind", "key", "at", "value", "on_kind", "on_key", F.col("stretch").alias("on_at"), "negated"), "dedup-met")
    while not met.filter(F.col("value") == LIKE).isEmpty():
        met = materialize(_resolved(met), "dedup-met")
    own = fates.filter("_row IS NOT NULL").withColumn("on_at", F.col("stretch"))
    settled = materialize(_resolved(own, met).select("_row", "value"), "dedup-settled")
    kept = materialize(dealt.join(settled.filter("value = 1"), "_row", "left_semi").select(left.columns), "dedup-kept")
    rest = dealt.join(settled.filter(F.col("value").isin(0, 1)), "_row", "left_anti").select(left.columns)
    rest = rest.join(kept.select("url"), "url", "left_anti").join(kept.select("_name"), "_name", "left_anti")
    return kept, materialize(rest.select(left.columns), "dedup-open")


def _resolved(values: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """``values`` with those like another one replaced by what that is, or by what it is like."""
    met = values if met is None else met
    other = met.select(*[F.col(c).alias(f"_{c}") for c in ("kind", "key", "at", "value", "on_kind", "on_key", "on_at", "negated")])
    like = F.col("value") == LIKE
    joined = values.join(
        other, like & (F.col("on_kind") == F.col("_kind")) & (F.col("on_key") == F.col("_key")) & (F.col("on_at") == F.col("_at")), "left"
    )
    known = F.when(F.col("negated") & F.col("_value").isin(0, 1), 1 - F.col("_value")).otherwise(F.col("_value"))
    changed = {c: F.when(like, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("on_kind", "on_key", "on_at")}
    changed["negated"] = F.when(like, F.col("negated") != F.coalesce("_negated", F.lit(False))).otherwise(F.col("negated"))
    changed["value"] = F.when(like, F.coalesce(known, F.lit(OPEN))).otherwise(F.col("value"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in values.columns])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Go through stretches in order.

    ``used`` holds per value whether it is used: True, False, None (open), or (value before the stretch, opposite).
    """
    names = ["_row", "stretch", "kind", "key", "value", "on_kind", "on_key", "negated"]

    def line(row, stretch, kind, key, state):
        if isinstance(state, tuple):
            (on_kind, on_key), negated = state
            return (row, stretch, kind, key, LIKE, on_kind, on_key, negated)
        return (row, stretch, kind, key, OPEN if state is None else int(state), None, None, False)

    def frame(lines):
        return pd.DataFrame(lines, columns=names).astype({"_row": "Int64"})

    def ends():
        lines = [line(None, stretch, *value, used[value]) for value in shared]
        for at in range(0, len(lines), 50_000):
            yield frame(lines[at : at + 50_000])

    stretch, used, shared = None, {}, set()
    for batch in batches:
        fates = []
        columns = ("_row", "_stretch", "url", "_name", "_of_url_met", "_of_name_met", "_of_url_shared", "_of_name_shared")
        for row, own, url, name, url_met, name_met, url_shared, name_shared in zip(*(batch[c] for c in columns), strict=True):
            if own != stretch:
                yield from ends()
                stretch, used, shared = own, {}, set()
            u, n = ("u", url), ("n", name)
            if u not in used:
                used[u] = (u, False) if url_met else False
                if url_shared:
                    shared.add(u)
            if n not in used:
                used[n] = (n, False) if name_met else False
                if name_shared:
                    shared.add(n)
            a, b = used[u], used[n]
            if a is True or b is True:
                kept = False
            elif a is None or b is None:
                kept = used[u] = used[n] = None
            elif a is False and b is False:
                kept = used[u] = used[n] = True
            elif a is False or b is False:
                # Kept just if the other one is free: then both are used, else that one is already.
                value, opposite = a or b
                kept = (value, not opposite)
                used[u], used[n] = (kept, True) if a is False else (True, kept)
            elif a == b:
                kept = (a[0], not a[1])
                used[u] = used[n] = True
            elif a[0] == b[0]:
                kept = False  # one of the two is used
            else:
                kept = used[u] = used[n] = None
            fates.append(line(row, stretch, None, None, kept))
        yield frame(fates)
    yield from ends()


def new_documents(found: DataFrame, known: DataFrame, order: str = "seq") -> DataFrame:
    """Documents of a retried page that neither repeat a known URL nor a known file name."""
    unseen = found.withColumn("_name", F.lower("filename")).join(known.select("url").distinct(), "url", "left_anti")
    names = known.select(F.lower("filename").alias("_name")).distinct()
    return dedup_by_name(unseen.join(names, "_name", "left_anti").drop("_name"), order).drop("skipped")
