"""Hard negatives by cover trees over norm-augmented vectors.

An integer inner product grows as the distance of two vectors of one length falls, so each candidate gets one more
component that brings all to the length of the longest. Candidates of a label lie in blocks; each block is a tree of
balls: a node's children are chosen farthest first, so they cover its points within a radius that falls from level to
level and lie apart by at least that radius. The product of an anchor with any point below a node differs from that with
the node's centre by at most the anchor's length times the radius. The descent takes the node of the greatest bound
first, leaves out nodes whose bounds lie outside the window, ends when no bound reaches the worst row that is kept, and
computes all products of the leaves it comes to.

Anchors meet the blocks of candidates in groups of bounded size, and each block returns no more rows to an anchor's window
than are asked for: the ranks over all blocks are a window with a group limit.

Defined cases: rows with a null id, label or vector, or with a null, infinite or not-a-number component take no part; a
shorter vector has zeros for what it lacks; equal rows count as often as they are there, an anchor is never its own
positive, its copies are; ties go to the smaller id; products are exact as long as they fit 64 bits; columns besides the
three named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_below, stored

#: Components of all vectors of a block; a block has so many rows as this allows, at least LEAST_ROWS.
BLOCK_NUMBERS, LEAST_ROWS = 1 << 19, 256
#: Points of a leaf, and children of a node.
LEAF, CHILDREN = 32, 48
#: The radius of children is that of their parent by this, if so few children suffice.
BASE = 2.0
#: Anchors that meet a block in one task, and those that descend a tree together.
TOGETHER, GROUP = 8192, 256
#: No id: the greatest number, so that real ids come first.
MISSING = np.iinfo(np.int64).max


def points(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vector, copies): what takes part, components times scale rounded down, equal rows as one."""
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    real = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", fine))
    whole = real.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector"))
    return whole.groupBy("id", "label", "vector").agg(F.count("*").alias("copies"))


class CoverTree:
    """A block of candidates: their ids, tags and vectors in the order of leaves, and the nodes above them."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, copies: np.ndarray, vectors: np.ndarray, most: int) -> None:
        """A row that is there more than `most` times counts as so many."""
        order = np.repeat(np.argsort(ids, kind="stable"), np.minimum(copies, most)[np.argsort(ids, kind="stable")])
        self.ids, self.tags, vectors = ids[order], tags[order], vectors[order]
        self.first = np.concatenate(([True], order[1:] != order[:-1]))[: len(order)]
        self.exact = bool(len(vectors) == 0 or float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2**52)
        self.vectors = vectors.astype(np.float64) if self.exact else vectors
        plain = vectors.astype(np.float64)
        length2 = np.einsum("ij,ij->i", plain, plain)
        self._augmented = np.column_stack([plain, np.sqrt(np.maximum(length2.max(initial=0) - length2, 0))])
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int]] = []  # nodes of a node; none for a leaf
        self.span: list[tuple[int, int]] = []  # points of a leaf, in their final order
        self._build()
        self.centres = self.vectors[self.centre]
        self.radii = np.array(self.radius) * (1 + 1e-9) + 1e-6
        final = np.array(self._leaves, dtype=np.int64)
        self.ids, self.tags, self.first, self.vectors = self.ids[final], self.tags[final], self.first[final], self.vectors[final]
        del self._augmented, self._leaves

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append((0, 0))
        self.span.append((0, 0))
        return len(self.centre) - 1

    def _build(self) -> None:
        """Nodes from the root on; leaves' points one after another, by id within a leaf."""
        a, self._leaves = self._augmented, []
        if not len(a):
            return
        first = int(np.argmin(((a - a.mean(axis=0)) ** 2).sum(axis=1)))
        away = np.sqrt(((a - a[first]) ** 2).sum(axis=1))
        waiting = [(self._node(first, float(away.max())), np.arange(len(a)), away)]
        while waiting:
            node, own, away = waiting.pop()
            if len(own) <= LEAF or self.radius[node] == 0:
                self.span[node] = (len(self._leaves), len(self._leaves) + len(own))
                self._leaves += own.tolist()
                continue
            part, nearest, to = a[own], np.zeros(len(own), dtype=np.int64), away.copy()
            centres = [self.centre[node]]
            while len(centres) < CHILDREN and to.max() > self.radius[node] / BASE:
                far = int(np.argmax(to))
                there = np.sqrt(((part - part[far]) ** 2).sum(axis=1))
                closer = there < to
                to[closer], nearest[closer] = there[closer], len(centres)
                to[far], nearest[far] = 0, len(centres)
                centres.append(int(own[far]))
            start = len(self.centre)
            members = [np.flatnonzero(nearest == k) for k in range(len(centres))]
            for k, m in enumerate(members):
                child = self._node(centres[k], float(to[m].max(initial=0)))
                waiting.append((child, own[m], to[m]))
            self.children[node] = (start, len(self.centre))

    def search(self, anchors: np.ndarray, who: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, k: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the first k candidates, by score and then id, in each window of each anchor; ids are MISSING where
        there are fewer.

        low, high: by anchor and window. The nodes that any window still needs are visited, the greatest bound first; a leaf's
        products are taken for the anchors with such a window, all at once. who: ids and tags of the anchors, which with
        leave_out are no candidates themselves.
        """
        n, windows = low.shape
        none = -np.inf if self.exact else np.iinfo(np.int64).min
        best = np.full((n, windows, k), none, dtype=self.vectors.dtype)
        best_ids = np.full((n, windows, k), MISSING, dtype=np.int64)
        self.visited = 0
        if not len(self.centre) or not n:
            return best, best_ids
        near = (anchors @ self.centres.T).astype(np.float64)
        reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.radii + np.abs(near) * 1e-12
        upper, lower = near + reach, near - reach

        def needed(node: int) -> np.ndarray:
            floor = np.maximum(low, best[:, :, -1])
            return (upper[:, node, None] >= floor) & (lower[:, node, None] <= high) & (low <= high)

        def entry(node: int, need: np.ndarray) -> tuple[float, int]:
            return -float(np.where(need, np.minimum(upper[:, node, None], high), -np.inf).max()), node

        heap = [entry(0, needed(0))]
        while heap:
            node = heapq.heappop(heap)[1]
            need = needed(node)  # what has been found meanwhile counts
            if not need.any():
                continue
            a, b = self.children[node]
            for child in range(a, b):
                if (more := need & needed(child)).any():
                    heapq.heappush(heap, entry(child, more))
            if b > a:
                continue
            a, b = self.span[node]
            self.visited += 1
            asked = np.flatnonzero(need.any(axis=1))
            scores = anchors[asked] @ self.vectors[a:b].T
            here = np.ones(scores.shape, dtype=bool)
            if leave_out:
                here = ~((self.ids[a:b] == who[0][asked][:, None]) & (self.tags[a:b] == who[1][asked][:, None]) & self.first[a:b])
            for w in range(windows):
                floor = np.maximum(low[asked, w], best[asked, w, -1])
                fit = here & (scores >= floor[:, None]) & (scores <= high[asked, w][:, None]) & need[asked, w][:, None]
                rows = np.flatnonzero(fit.any(axis=1))
                if not len(rows):
                    continue
                at = asked[rows]
                both = np.concatenate([best[at, w], np.where(fit[rows], scores[rows], none)], axis=1)
                ids = np.concatenate([best_ids[at, w], np.where(fit[rows], self.ids[a:b], MISSING)], axis=1)
                order = np.lexsort((ids, -both if self.exact else np.invert(both)), axis=-1)[:, :k]
                best[at, w], best_ids[at, w] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        return best, best_ids


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    rows = [np.asarray(v, dtype=np.int64) for v in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _trees(rows: DataFrame, most: int) -> DataFrame:
    """(label, chunk, tree): a tree for each label and chunk of rows (id, tag, label, copies, vector, chunk)."""

    def build(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(block["id"].to_numpy(), block["tag"].to_numpy(), block["copies"].to_numpy(), _matrix(block["vector"]), most)
        return pd.DataFrame({"label": [key[0]], "chunk": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    kind = rows.schema["label"].dataType.simpleString()
    return rows.groupBy("label", "chunk").applyInPandas(build, f"label {kind}, chunk long, tree binary")


def _descend(trees: DataFrame, anchors: DataFrame, own: bool, k: int, percent: tuple[int, int] | None = None) -> DataFrame:
    """For anchors (id, tag, label, vector, nths, tops, band, shard) and trees (label, tree, band,
    shard): (id, tag, nth, score, other) of the first k candidates of each window in each tree of the anchor's own label,
    or of other labels. The nth window is percent of its top, or has no ends. A band and shard is one task's work, of bounded size."""

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(held) and len(asked):
            vectors, labels, ids, tags = _matrix(asked["vector"]), asked["label"].to_numpy(), asked["id"].to_numpy(), asked["tag"].to_numpy()
            sizes = [len(n) for n in asked["nths"]]
            nths, tops = (np.zeros((len(asked), max(sizes)), dtype=np.int64) for _ in range(2))
            real = np.arange(max(sizes)) < np.array(sizes)[:, None]
            for name, to in (("nths", nths), ("tops", tops)):
                to[real] = np.concatenate(asked[name].to_list())
            if percent:
                bounds = [[(-(-t * percent[0] // 100), t * percent[1] // 100) for t in own] for own in tops.tolist()]
                low, high = (np.array([[x[k] for x in own] for own in bounds], dtype=np.int64) for k in range(2))
            else:
                low, high = np.full(tops.shape, np.iinfo(np.int64).min), np.full(tops.shape, np.iinfo(np.int64).max)
            low, high = np.where(real, low, 1), np.where(real, high, 0)
            small = float(np.abs(vectors).max(initial=0))
            for label, body in zip(held["label"], held["tree"], strict=True):
                tree: CoverTree = pickle.loads(body)
                width = tree.vectors.shape[1]
                if tree.exact and small * float(np.abs(tree.vectors).max(initial=0)) * width >= 2**52:
                    tree.vectors, tree.centres, tree.exact = tree.vectors.astype(np.int64), tree.centres.astype(np.int64), False
                mine = np.flatnonzero((labels == label) == own)
                fitted = np.zeros((len(mine), width), dtype=tree.vectors.dtype)
                fitted[:, : vectors.shape[1]] = vectors[mine][:, :width]
                for start in range(0, len(mine), GROUP):
                    at = mine[start : start + GROUP]
                    kind = np.float64 if tree.exact else np.int64
                    scores, others = tree.search(fitted[start : start + GROUP], (ids[at], tags[at]), low[at].astype(kind), high[at].astype(kind), k, own)
                    row, window, _ = found = np.nonzero(others != MISSING)
                    out.append(pd.DataFrame({"id": ids[at][row], "tag": tags[at][row], "nth": nths[at][row, window], "score": scores[found].astype(np.int64), "other": others[found]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("id", "tag", "nth", "score", "other")})

    return trees.groupBy("shard", "band").cogroup(anchors.groupBy("shard", "band")).applyInPandas(search, "id long, tag long, nth long, score long, other long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the first k of each anchor's window."""
    order = Window.partitionBy("id", "tag", "nth").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(points: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of points() that is_anchor
    takes: of each of an anchor's first positives, the first negatives with low to high percent of its score."""
    tagged = points.withColumn("tag", F.xxhash64("label", "vector"))
    counts = stored(tagged.groupBy("label").agg(F.sum(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")))
    per_block = F.greatest(F.lit(LEAST_ROWS), F.lit(BLOCK_NUMBERS) / F.greatest("width", F.lit(1)))
    chunks = counts.select("label", F.ceil(F.col("n") / per_block).alias("chunks"))
    rows = stored(tagged.join(broadcast_below(chunks), "label").withColumn("chunk", F.pmod(F.xxhash64("id", "tag"), F.col("chunks"))))
    trees = stored(_trees(rows, max(positives, negatives) + 1))
    shards = max(1, trees.count())
    shard = F.pmod(F.xxhash64("label", "chunk"), F.lit(shards))
    anchors = rows.filter(is_anchor)
    bands = max(1, -(-anchors.count() // TOGETHER))
    band = F.pmod(F.xxhash64("id", "tag", F.lit(1)), F.lit(bands))
    all_bands = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long")))
    placed = trees.withColumn("shard", shard).withColumn("band", all_bands)

    # first the positives, out of the blocks of the anchor's label only
    whole = [F.array(F.lit(0).cast("long")).alias("nths"), F.array(F.lit(0).cast("long")).alias("tops")]
    to_own = anchors.select("id", "tag", "label", "vector", *whole, band.alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).withColumn("shard", shard)
    near = _first(_descend(placed, to_own, True, positives), positives).select("id", "tag", F.col("rank").cast("long").alias("nth"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id"))
    near = stored(near)

    # then each positive's window, out of the blocks of all other labels
    each = near.groupBy("id", "tag").agg(F.collect_list(F.struct("nth", "positive_score")).alias("w"))  # at most `positives` windows each
    asked = anchors.join(each, ["id", "tag"])
    to_all = asked.select("id", "tag", "label", "vector", F.col("w.nth").alias("nths"), F.col("w.positive_score").alias("tops"), band.alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = _first(_descend(placed, to_all, False, negatives, (low, high)), negatives)
    times = anchors.select("id", "tag", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "tag")
    out = found.join(near, ["id", "tag", "nth"]).join(times, ["id", "tag"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(points: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """points with the next label, in a circle, where id is divisible by every; equal rows are put together again."""
    label = F.when(F.col("id") % every == 0, ((F.col("label") + 1) % labels).cast(points.schema["label"].dataType)).otherwise(F.col("label"))
    return points.withColumn("label", label).groupBy("id", "label", "vector").agg(F.sum("copies").alias("copies"))
