"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.session import materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; nodes are connected exactly if their roots are equal.

    Each round every node joins its smallest neighbour and links are redrawn between the joined nodes, repeated
    links dropping out, until none is left.  With node names that are hashes the rounds grow with the logarithm of
    the longest chain.  All state is written to the shared folder; no component meets in one task.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    edges = materialize(_once(edges), "component-links")
    both = edges.select("u").union(edges.select("v")).distinct()
    labels = materialize(both.select(F.col("u").alias("node"), F.col("u").alias("root")), "component-labels")
    while not edges.isEmpty():
        sides = edges.union(edges.select(F.col("v"), F.col("u")))
        step = sides.groupBy("u").agg(F.min("v").alias("v"))
        step = materialize(step.select("u", F.least("u", "v").alias("to")), "component-step")
        labels = materialize(
            labels.join(step, F.col("root") == F.col("u"), "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "component-labels",
        )
        first = edges.join(step, "u").select(F.col("to").alias("p"), "v")
        moved = first.join(step.withColumnRenamed("to", "q"), F.col("v") == F.col("u")).select(
            F.col("p").alias("u"), F.col("q").alias("v")
        )
        edges = materialize(_once(moved.filter("u <> v")), "component-links")
    return labels


def _once(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
