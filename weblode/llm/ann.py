"""Nearest neighbours by inner product through low-dimensional stable projections.

Vectors are lifted so that the largest inner product is the smallest distance (one more component makes all norms
equal), then projected to ``DIMENSIONS`` Gaussian (2-stable) directions.  The projected distance over the true one
is chi-square distributed, so a search in the projected space can tell when it is done: projected neighbours are
taken in order of distance and verified on the original vectors until the chi-square test says that any vector
nearer than the k-th found would, with probability ``CONFIDENCE``, have been seen.

The projected space is cut by a kd-tree into cells; every vector is stored in its cell, and each cell holds a small
kd-tree of its own with leaves of ``LEAF`` vectors.  A query first searches its own cell, which bounds its k-th
distance, and is then sent only to cells whose box the test can't rule out.  Cells are groups of one shuffle; neither
all vectors nor all queries meet in one task.

Defined cases.  Null, zero and wrong-length vectors and those with null or non-finite components take no part.
Rows that repeat an id are candidates each, and none of them is a candidate of its own id.  Ties go to the smaller
id.  Fewer candidates than k give all.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.session import materialize

DIMENSIONS = 12
CONFIDENCE = 0.98
LEAF = 64
#: Vectors of a cell, about; and the vectors the cuts between cells are learned from, at most.
CELL = 2000
#: Leaves verified at a time before a bound is known, and what rounding may change in an inner product, as a share.
STEP = 4
SLACK = 1e-9
BLOCK = 20_000
CUT_SAMPLE = 50_000
SEED = 7


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value a chi-square variable of these degrees stays below with probability ``p`` (even degrees)."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= mid / 2 / i
            total += term
        low, high = (mid, high) if 1 - np.exp(-mid / 2) * total < p else (low, mid)
    return low


LIMIT = chi_square_quantile(CONFIDENCE, DIMENSIONS)


def kd_split(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves along the widest direction until at most ``size`` are left."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        own = points[rows]
        axis = int((own.max(0) - own.min(0)).argmax())
        order = np.argsort(own[:, axis], kind="stable")
        half = len(rows) // 2
        stack += [rows[order[:half]], rows[order[half:]]]
    return leaves


def cell_cuts(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Inner nodes (axis, value) of a complete kd-tree with ``cells`` leaves (a power of two), in heap order."""
    cuts, level = [], [np.arange(len(points))]
    while len(level) < cells:
        following = []
        for rows in level:
            own = points[rows]
            axis = int((own.max(0) - own.min(0)).argmax()) if len(rows) else 0
            value = float(np.median(own[:, axis])) if len(rows) else 0.0
            cuts.append((axis, value))
            below = own[:, axis] < value if len(rows) else np.zeros(0, bool)
            following += [rows[below], rows[~below]]
        level = following
    return cuts


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each projected vector."""
    at = np.zeros(len(points), np.int64)
    if cuts:
        axes, values = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        while at[0] < len(cuts):
            at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= values[at])
    return at - len(cuts)


def cell_boxes(cuts: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest corner of each cell."""
    low, high = [np.full(DIMENSIONS, -np.inf)], [np.full(DIMENSIONS, np.inf)]
    for i, (axis, value) in enumerate(cuts):
        left, right = high[i].copy(), low[i].copy()
        left[axis] = right[axis] = value
        low += [low[i], right]
        high += [left, high[i]]
    return np.array(low[len(cuts) :]), np.array(high[len(cuts) :])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    total = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        at = points[:, axis, None]
        gap = np.maximum(np.maximum(low[None, :, axis] - at, at - high[None, :, axis]), 0.0)
        total += gap * gap
    return total


class Cell:
    """The vectors of one cell with their kd-tree, in the order of its leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        leaves = kd_split(projected, LEAF)
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        ends = np.cumsum([len(r) for r in leaves])
        self.rows = [np.arange(e - len(r), e) for r, e in zip(leaves, ends, strict=True)]
        self.low = np.array([projected[r].min(0) for r in leaves])
        self.high = np.array([projected[r].max(0) for r in leaves])

    def search(self, own: int, vector: np.ndarray, gaps: np.ndarray, norms: float, k: int, bound: float):
        """The best (score, id) here, at most k and none below what ``bound``, a known k-th distance, asks for.

        ``gaps`` are the query's distances to the leaves; ``norms`` turns scores to squared distances.  Leaves are
        verified nearest first, a few at a time while no bound is known, until the test stops.
        """
        order = np.argsort(gaps, kind="stable")
        scores, names, at = np.empty(0), np.empty(0, np.int64), 0
        while at < len(order):
            near = order[at : at + STEP] if np.isinf(bound) else order[at:]
            near = near[gaps[near] <= LIMIT * max(bound, 0.0)]
            if not len(near):
                break
            at += len(near)
            rows = np.concatenate([self.rows[i] for i in near])
            quick = self.vectors[rows] @ vector
            least = (norms - bound) / 2
            if len(quick) > 2 * k:  # the own vector may be among them
                least = max(least, np.partition(quick, len(quick) - k - 1)[len(quick) - k - 1])
            rows = rows[(quick >= least - SLACK * norms) & (self.ids[rows] != own)]
            scores = np.concatenate([scores, inner(self.vectors[rows], vector)])
            names = np.concatenate([names, self.ids[rows]])
            best = np.lexsort((names, -scores))[:k]
            scores, names = scores[best], names[best]
            if len(scores) >= k:
                bound = min(bound, norms - 2 * scores[k - 1])
        return scores, names


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component in order so that every task gets the same value."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def usable(vector: Column) -> Column:
    """A vector that is neither null nor zero and has finite components only."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _projections(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row chosen by ``is_query``, its k nearest other rows."""
    rows = vectors.filter(usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # The usual length wins; others can't be compared with it.
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(square).alias("top"))
    widest = widths.orderBy(F.desc("n"), "width").first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if widest is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width, top, count = widest["width"], widest["top"], widest["n"]
    rows = rows.filter(F.size("v") == width)
    projection = _projections(width)

    def lifted(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        own = _stack(batch["v"])
        rest = np.sqrt(np.maximum(top - (own * own).sum(1), 0.0))
        return own, np.hstack([own, rest[:, None]]) @ projection

    cells = 1 << max(0, int(np.ceil(np.log2(max(1.0, count / CELL)))))
    taken = rows.orderBy(F.xxhash64("id")).limit(CUT_SAMPLE) if cells > 1 else rows.limit(0)
    sample = taken.select("v").toPandas()
    cuts = cell_cuts(lifted(sample)[1], cells) if len(sample) else []

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own, points = lifted(batch)
                # A query is the vector with a last component of 0, so its projection lacks that part.
                asks = own @ projection[:-1]
                yield pd.DataFrame(
                    {
                        "cell": cell_of(points, cuts),
                        "home": cell_of(asks, cuts),
                        "id": batch["id"],
                        "v": list(own),
                        "p": list(points),
                        "q": list(asks),
                        "asks": batch["asks"].fillna(False).astype(bool),
                    }
                )

    fields = "cell bigint, home bigint, id bigint, v array<double>, p array<double>, q array<double>, asks boolean"
    placed = materialize(rows.filter("id IS NOT NULL").mapInPandas(place, fields), "ann-placed")
    stored = placed.select("cell", "id", "v", "p")
    queries = placed.filter("asks").dropDuplicates(["id"]).select("home", "id", "v", "q")
    queries = materialize(queries, "ann-queries")
    members = placed.groupBy("cell").agg(F.count("*").alias("n_members"))
    hits = "query_id bigint, vec_id bigint, score double"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            cell = Cell(left["id"].to_numpy(), _stack(left["v"]), _stack(left["p"]))
            queries, gaps = _stack(right["v"]), box_distances(_stack(right["q"]), cell.low, cell.high)
            norms = (queries * queries).sum(1) + top
            for i, (own, bound) in enumerate(zip(right["id"], right["bound"], strict=True)):
                scores, names = cell.search(own, queries[i], gaps[i], norms[i], k, bound)
                out += [(own, n, s) for s, n in zip(scores.tolist(), names.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """Search ``cell, id, bound``.  Full cells are dealt out in parts and their queries in blocks, so that no
        group exceeds about ``CELL`` vectors or ``BLOCK`` queries; each block meets each part."""
        shape = asked.groupBy("cell").agg(F.count("*").alias("n_asked")).join(members, "cell")
        shape = shape.select(
            "cell",
            F.ceil(F.col("n_members") / CELL).cast("int").alias("parts"),
            F.ceil(F.col("n_asked") / BLOCK).cast("int").alias("blocks"),
        )
        shape = materialize(shape, "ann-shape")
        dealt = stored.join(shape, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asking = asked.join(queries.select("id", "v", "q"), "id").join(shape, "cell")
        asking = asking.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "part", "block"]
        return (
            dealt.select(*keys, "id", "v", "p")
            .groupBy(*keys)
            .cogroup(asking.select(*keys, "id", "v", "q", "bound").groupBy(*keys))
            .applyInPandas(search, hits)
        )

    home = queries.select(F.col("home").alias("cell"), "id", F.lit(float("inf")).alias("bound"))
    found = materialize(searched(home), "ann-home")
    if cells > 1:
        # The k-th best of the home cell bounds what other cells must offer.
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kth = found.withColumn("at", order).filter(F.col("at") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
        low, high = cell_boxes(cuts)

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                vectors = _stack(batch["v"])
                worst = batch["worst"].to_numpy(np.float64, na_value=np.nan)
                bound = np.maximum((vectors * vectors).sum(1) + top - 2 * worst, 0.0)
                bound[np.isnan(worst)] = np.inf
                near = box_distances(_stack(batch["q"]), low, high) <= (LIMIT * bound)[:, None]
                near[np.arange(len(batch)), batch["home"]] = False
                asks, cell = np.nonzero(near)
                yield pd.DataFrame({"cell": cell, "id": batch["id"].to_numpy()[asks], "bound": bound[asks]})

        sent = queries.join(kth, "id", "left").mapInPandas(send, "cell bigint, id bigint, bound double")
        found = found.unionByName(searched(materialize(sent, "ann-sent")))
    best = F.slice(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k
    )
    ranked = found.groupBy("query_id").agg(best.alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
