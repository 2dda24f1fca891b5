"""Near-duplicate documents by an LSH forest over word shingles.

1. Every document becomes its set of five-word shingles and a signature of MinHash values.  Documents with the same
   set are one node from here on, whatever their number.
2. Each tree of the forest sorts the nodes by its own order of the signature.  Nodes that share the first
   ``ROOT_DEPTH`` values are a region.  A region larger than ``REGION`` is cut where neighbours in the sorted order
   share the shortest prefix, so dense regions are looked at deeper than thin ones, and what is compared are always
   the neighbours of longest common prefix.  Regions found again by another tree are dropped.
3. Within a region all pairs are confirmed on the full sets (counts of common shingles come from one matrix product
   per slice of shingles); links that connect its classes are emitted, never all pairs.
4. Members of root regions that did not stay whole (cut by size, by shingles or at the border of two tasks) are
   joined exactly: two sets over the threshold share one of the rarest shingles of both, so nodes meet by those, and
   pairs not yet connected are confirmed on the full sets, each pair by itself.
5. Links are contracted to components; a document is kept if it has its component's smallest id.

A pair at the threshold shares a root region in some tree with probability over 0.9999.  Whole regions compare all
their pairs, and the exact join finds every pair of cut ones.

Defined cases.  Null and empty texts have no shingles, link with nothing and are their own component.  Texts of
fewer words than a shingle have one: all their words.  Repeated rows and equal ids count as one id; the smallest
non-null id names a component, and a component of null ids only has a null name and is kept.  An empty table gives
an empty result.  Memory per task is bounded by ``REGION`` nodes and ``REGION_SHINGLES`` shingles, or by two
documents where these alone are longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.common import tasks_for
from weblode.llm.components import components
from weblode.session import materialize

SHINGLE = 5
THRESHOLD_PERCENT = 85
TREES = 12
ROOT_DEPTH = 3
#: MinHash values of a document: the roots of all trees, which no two trees share.
HASHES = TREES * ROOT_DEPTH
#: Values a tree's order looks at beyond its root.
DEEPER = 12
#: With these trees a pair of 80 in a hundred shares a root with probability 0.9998; below, pairs would be lost.
LEAST_PERCENT = 80
REGION = 1500
REGION_SHINGLES = 3_000_000
ROWS_PER_TASK = 400_000
#: Bins in which shingles are counted to put rare ones first; any order of shingles gives the same links.
BINS = 1 << 18
#: Rarest shingles a node brings to a meeting, to rule pairs out before their texts are sent.
HEAD = 32
#: Nodes of one shingle beyond this number meet in blocks of it, each pair of blocks by itself.
BLOCK = 1000
#: Sets a task remembers while it confirms pairs.
SETS_KEPT = 200

_rng = np.random.default_rng(20_250_101)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_POWERS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, computed once per task and word."""

    KEPT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII blanks
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, n if n < SHINGLE else 0, np.uint64)
    for i in range(width):
        total = (total + values[i : n - width + 1 + i]) * _POWERS[i]
    return np.unique(_mixed(total))


def node_name(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    out = np.empty(HASHES, np.uint64)
    block = 1 << 15
    for k in range(HASHES):
        low = np.uint64(2**64 - 1)
        for a in range(0, len(shingles), block):
            low = min(low, (shingles[a : a + block] * _MULTIPLY[k] + _ADD[k]).min())
        out[k] = low
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def tree_order(tree: int) -> np.ndarray:
    """The order in which a tree looks at the signature: its own root values, then others."""
    root = np.arange(tree * ROOT_DEPTH, (tree + 1) * ROOT_DEPTH)
    rest = np.setdiff1d(np.arange(HASHES), root)
    return np.concatenate([root, np.random.default_rng(tree).permutation(rest)[:DEEPER]])


_ORDERS = np.array([tree_order(t) for t in range(TREES)])


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, n_shingles, node, signature`` per document; node and signature are null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "hash": batch["hash"],
                    "n_shingles": [len(s) for s in sets],
                    "node": [node_name(s) if len(s) else None for s in sets],
                    "signature": [signature(s).astype(">u4").tobytes() if len(s) else None for s in sets],
                }
            )

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return given.mapInPandas(run, "doc_id bigint, hash bigint, n_shingles bigint, node binary, signature binary")


def _sorted_trees(nodes: DataFrame) -> DataFrame:
    """One row per node and tree: ``tree, key`` (the signature in the tree's order), ``node, n_shingles``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            values = np.frombuffer(b"".join(batch["signature"]), ">u4").reshape(len(batch), HASHES)
            # Root values whole, deeper ones by their leading half: they only refine the order.
            for t in range(TREES):
                root = np.ascontiguousarray(values[:, _ORDERS[t][:ROOT_DEPTH]])
                deep = np.ascontiguousarray((values[:, _ORDERS[t][ROOT_DEPTH:]] >> 16).astype(">u2"))
                keys = [a.tobytes() + b.tobytes() for a, b in zip(root, deep, strict=True)]
                yield pd.DataFrame({"tree": t, "key": keys, "node": batch["node"], "n_shingles": batch["n_shingles"]})

    return nodes.select("node", "signature", "n_shingles").mapInPandas(
        run, "tree int, key binary, node binary, n_shingles bigint"
    )


def _common(a: bytes, b: bytes) -> int:
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    return n


def cut_region(keys: list[bytes], weights: list[int], limit: int, most: int) -> list[tuple[int, int]]:
    """Cut a sorted region into runs of at most ``limit`` rows and ``most`` weight, where prefixes are shortest.

    A cut is looked for in the second half of what fits, so runs are never much smaller than they must be.
    """
    runs, begin = [], 0
    while begin < len(keys):
        end, total = begin, 0
        while end < len(keys) and end - begin < limit and (end == begin or total + weights[end] <= most):
            total += weights[end]
            end += 1
        if end < len(keys):
            half = begin + (end - begin + 1) // 2
            end = min(range(max(half, begin + 1), end + 1), key=lambda i: (_common(keys[i - 1], keys[i]), -i))
        runs.append((begin, end))
        begin = end
    return runs


def _regions(nodes: DataFrame, rows: int) -> DataFrame:
    """Members of the regions of all trees: ``region, node``, regions of one member left out.

    Members of root regions that were cut or may go on in another task stand once more, under a null region.
    """
    tasks = tasks_for(rows * TREES, ROWS_PER_TASK)
    trees = _sorted_trees(nodes)
    ranged = trees.repartitionByRange(max(tasks, 2 * TREES), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, held, at = TaskContext.get().partitionId() << 40, 0, [], None
        out: list[tuple[int | None, bytes]] = []
        cut = True  # the first root may have begun in the task before

        def close(whole: bool, last: bool = False) -> None:
            # Cut what is held; unless the region is over, its last run waits for what follows.
            nonlocal made, held, cut
            runs = cut_region([h[0] for h in held], [h[2] for h in held], REGION, REGION_SHINGLES)
            cut = cut or last or not whole or len(runs) > 1
            if cut:
                out.extend((None, h[1]) for h in (held if whole else held[: runs[-1][0]]))
            for a, b in runs if whole else runs[:-1]:
                if b - a > 1:
                    out.extend((base + made, held[i][1]) for i in range(a, b))
                    made += 1
            held = [] if whole else held[runs[-1][0] :]

        for batch in batches:
            for tree, key, node, n in zip(*[batch[c] for c in ("tree", "key", "node", "n_shingles")], strict=True):
                root = (tree, key[: 4 * ROOT_DEPTH])
                if root != at:
                    if len(held) > 1 or (held and cut):
                        close(True)
                    held, cut = [], at is None
                    at = root
                held.append((key, node, n))
                if len(held) > 4 * REGION:
                    close(False)
            if out:
                yield frame(out)
                out.clear()
        if held:
            close(True, last=True)
        yield frame(out)

    def frame(out: list[tuple[int | None, bytes]]) -> pd.DataFrame:
        return pd.DataFrame({"region": pd.array([r for r, _ in out], "Int64"), "node": [n for _, n in out]})

    both = materialize(ranged.mapInPandas(run, "region bigint, node binary"), "neardup-members")
    members = both.filter("region IS NOT NULL")
    # The same members under another tree add nothing.
    name = F.xxhash64("node")
    shape = members.groupBy("region").agg(F.count("*").alias("n"), F.sum(name % 1_000_003).alias("s"), F.bit_xor(name).alias("x"))
    once = shape.groupBy("n", "s", "x").agg(F.min("region").alias("region")).select("region")
    crowded = both.filter("region IS NULL").distinct()
    return members.join(once, "region", "left_semi").unionByName(crowded)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[number] > 1
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    common = np.zeros((n, n), np.float32)  # counts stay below 2^24, exact in this type
    width = 4096
    top = int(number[-1]) + 1 if len(number) else 0
    edges = np.searchsorted(number, np.arange(0, top + width, width))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        block = np.zeros((n, min(width, top - k * width)), np.float32)
        block[owner[a:b], number[a:b] - k * width] = 1
        common += block @ block.T
    return common


def linked_pairs(sets: list[np.ndarray], percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int]]:
    """Confirmed links that connect the classes of these sets: every pair is compared, a spanning forest returned."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets)
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(100 * common.astype(np.float64) >= percent * union, 1))
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


def _texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes; another text under the same id comes along."""
    named = wanted.join(nodes.select("node", "first_id"), "node")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("text"))
    return named.join(texts, F.col("first_id").eqNullSafe(F.col("_id"))).select("node", "text")


def _confirmed(members: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links within regions: ``a, b``.  The texts of members only are sent to their regions."""

    def run(region: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        found: dict[bytes, np.ndarray] = {}
        for node, text in zip(region["node"], region["text"], strict=True):
            if node not in found:
                shingles = shingle_set(text, hashes)
                if node_name(shingles) == node:  # another text under the same id is not this node
                    found[node] = shingles
        names = list(found)
        pairs = linked_pairs(list(found.values()), percent) if len(names) > 1 else []
        return pd.DataFrame([(names[i], names[j]) for i, j in pairs], columns=["a", "b"])

    held = _texts(members.select("node").distinct(), docs, nodes).withColumnRenamed("node", "_node")
    sent = members.join(held, F.col("node") == F.col("_node")).select("region", "node", "text")
    return sent.groupBy("region").applyInPandas(run, "a binary, b binary")


def may_link(common: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can still reach the threshold, given how many of their ``HEAD`` rarest shingles are common.

    Of two heads in one order, the one that ends first holds all it shares with the other set in the other head too,
    so no more than its own remaining shingles can be added.
    """
    rest = np.maximum(n - HEAD, 0)
    most = common + np.maximum(rest[:, None], rest[None, :])
    most = np.minimum(most, np.minimum(n[:, None], n[None, :]))
    return 100 * most >= percent * (n[:, None] + n[None, :] - most)


def _joined_exactly(crowded: DataFrame, docs: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between crowded nodes of different ``labels``: all that are over the threshold."""
    texts = materialize(_texts(crowded, docs, nodes), "neardup-crowded")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, np.ndarray]]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                shingles = shingle_set(text, hashes)
                if node_name(shingles) == node:
                    yield node, shingles

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BINS, np.int64)
        for _, shingles in sets(batches):
            counts += np.bincount((shingles % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"bin": used, "n": counts[used]})

    seen = texts.mapInPandas(binned, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(BINS, np.int64)
    often[seen["bin"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for node, shingles in sets(batches):
            n = len(shingles)
            order = np.lexsort((shingles, often[(shingles % np.uint64(BINS)).astype(np.int64)]))
            ranked = shingles[order[: max(HEAD, n - -(-percent * n // 100) + 1)]]
            first = ranked[: n - -(-percent * n // 100) + 1].view(np.int64)
            head = ranked[:HEAD].tobytes()
            for a in range(0, len(first), 10_000):
                yield pd.DataFrame({"shingle": first[a : a + 10_000], "node": node, "n": n, "head": head})

    # A node without a link yet is a class of its own.
    named = labels.select(F.col("node").alias("_node"), "root")
    rooted = texts.join(named, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = materialize(rooted.distinct(), "neardup-roots")
    first = texts.mapInPandas(rarest, "shingle bigint, node binary, n bigint, head binary").join(roots, "node")
    first = materialize(first, "neardup-first")
    # Counted before the shuffle: only shingles of different classes can bring anything new.
    met = first.groupBy("shingle").agg(F.count("*").alias("of"), F.min("root").alias("low"), F.max("root").alias("high"))
    met = materialize(met.filter("low <> high").select("shingle", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks")), "neardup-met")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = first.join(met, "shingle").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["shingle", "lower", "upper"]
    placed = placed.select(
        "shingle", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"), "own", "node", "root", "n", "head"
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in batch.itertuples(index=False, name=None))
        for (_, lower, upper), group in groupby(rows, key=lambda r: r[:3]):
            _, _, _, blocks, names, roots, n, heads = zip(*group, strict=True)
            if len(set(roots)) < 2:
                continue
            block, root = np.array(blocks), np.unique(np.array(roots, object), return_inverse=True)[1]
            able = may_link(common_counts([np.frombuffer(h, np.uint64) for h in heads]), np.array(n), percent)
            able &= root[:, None] != root[None, :]
            if lower < upper:
                able &= block[:, None] != block[None, :]
            i, j = np.nonzero(np.triu(able, 1))
            for a in range(0, len(i), 10_000):
                pairs = [sorted((names[x], names[y])) for x, y in zip(i[a : a + 10_000], j[a : a + 10_000], strict=True)]
                yield pd.DataFrame(pairs, columns=["a", "b"])

    dealt = placed.repartition(*key).sortWithinPartitions(*key)
    pairs = materialize(dealt.mapInPandas(meet, "a binary, b binary").distinct(), "neardup-pairs")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        kept: dict[bytes, np.ndarray] = {}

        def known(node: bytes, text: str) -> np.ndarray | None:
            if node not in kept:
                shingles = shingle_set(text, hashes)
                if node_name(shingles) != node:
                    return None
                if len(kept) >= SETS_KEPT or sum(map(len, kept.values())) > REGION_SHINGLES:
                    kept.clear()
                kept[node] = shingles
            return kept[node]

        for batch in batches:
            links = []
            for a, b, s, t in zip(*[batch[c] for c in ("a", "b", "s", "t")], strict=True):
                x, y = known(a, s), known(b, t)
                if x is not None and y is not None:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        links.append((a, b))
            yield pd.DataFrame(links, columns=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    sent = pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t")
    return sent.mapInPandas(confirm, "a binary, b binary").distinct()


def _classified(docs: DataFrame, percent: int) -> DataFrame:
    """Per document: ``doc_id, hash, node, n_shingles, component_id, kept``."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the trees are made for similarities of {LEAST_PERCENT} to 100 in a hundred")
    features = materialize(_features(docs), "neardup-features")
    rows = materialize(
        features.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "neardup-nodes",
    )
    members = materialize(_regions(rows, rows.count()), "neardup-regions")
    links = materialize(_confirmed(members.filter("region IS NOT NULL"), docs, rows, percent), "neardup-links")
    labels = components(links)
    crowded = members.filter("region IS NULL").select("node")
    if not crowded.isEmpty():
        further = materialize(_joined_exactly(crowded, docs, rows, labels, percent), "neardup-further")
        if not further.isEmpty():
            labels = components(links.unionByName(further))
    named = rows.select("node", "first_id").join(labels, "node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("smallest"))
    classes = named.join(smallest, "root").select("node", "smallest")
    labelled = (
        rows.select("node", "first_id")
        .join(classes, "node", "left")
        .select(F.col("node").alias("_node"), F.coalesce("smallest", "first_id").alias("_component"))
    )
    out = features.drop("signature").join(labelled, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select(
        "doc_id",
        "hash",
        "node",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.  ``percent`` is at least ``LEAST_PERCENT``."""
    return _classified(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def distinct_documents(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One document of each class, with all its columns; rows that repeat it go too."""
    kept = _classified(docs, percent).filter("kept").groupBy("doc_id", "node").agg(F.min("hash").alias("_of_text"))
    kept = kept.select(F.col("doc_id").alias("_of_id"), "_of_text").distinct()
    kept = materialize(kept, "neardup-kept")
    marked = docs.withColumn("_neardup_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(kept["_of_id"]) & (F.col("_neardup_text") == kept["_of_text"])
    once = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_neardup_text"])
    return once.drop("_neardup_text")
