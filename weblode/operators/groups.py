"""Rows connected through shared values, found in a few passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.session import materialize

#: Pairs a task joins at a time.
PAIRS_PER_TASK = 500_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, root`` of one task's pairs: nodes that its pairs connect have one root, the smallest of them."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            p, q = root(a), root(b)
            if p != q:
                above[max(p, q)] = min(p, q)
    yield pd.DataFrame({"node": list(above), "root": [root(x) for x in above]}, dtype="int64")


def connected(pairs: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``a, b`` (bigint); nodes have one root exactly if pairs connect them.

    Each task joins its share of the pairs by itself; nodes with roots in several tasks make the pairs of the next pass.
    Every pair's ends are joined where it lies, so the nodes at least halve each pass, and once the pairs fit one task it
    finishes them: a long chain takes as many passes as its pairs take tasks halved, not as it has links.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    labels = None
    while True:
        tasks = max(1, -(-pairs.count() // PAIRS_PER_TASK))
        forest = materialize(pairs.repartition(tasks, "a", "b").mapInPandas(_joined, "node bigint, root bigint"), "forest")
        least = forest.groupBy("node").agg(F.min("root").alias("root"))
        if labels is None:
            labels = least
        else:
            moved = least.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        if tasks == 1:
            return materialize(labels, "connected")
        labels = materialize(labels, "connected")
        other = forest.join(least.withColumnRenamed("root", "b"), "node").select(F.col("root").alias("a"), "b")
        pairs = materialize(other.filter("a <> b").distinct(), "pairs")
