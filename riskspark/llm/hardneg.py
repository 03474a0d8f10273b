"""Hard-negative mining by cover trees over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that all candidates lie on one sphere
and the inner product with an anchor (whose extra component is 0) falls with the angle.  Candidates are dealt into cells
around ``cells`` centres of a sample, cells into trees of about ``TREE`` vectors, and each tree is a cover tree: a node is
a vector with a covering radius, children lie within half the radius above.  A node's angle to the anchor and the angle
of its radius bound every inner product below it.

Anchors come in blocks, each block meets every tree.  A search pops the node with the highest bound first, scores all
its children with one product, and goes on with the anchors whose windows the child can still reach: a child whose
bounds lie outside all windows, or below the worst rank kept, is skipped.  Scores are exact integers.

* Positives: the ``positives`` best other rows of the anchor's label.
* Negatives: for each positive the ``negatives`` best rows of other labels with
  low * positive_score <= 100 * negative_score <= 100 * positive_score.

Vectors that are equal and share a label stand once in a tree, with the least ``positives + 1`` (at least ``negatives``)
of their ids, as more can never be returned.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part.  A vec_id counts once
(the least label, then the least vector).  Shorter vectors are filled with zeros; an empty vector is all zeros.  Ties go
by smaller id.  Components are cut to +-2^30 after rounding; where products could leave 2^53 they are summed as 64-bit
integers.  An anchor without positives, or whose windows hold nothing, gives no row; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskspark.llm import chunks, common

TREE = 2048
LEVELS = 2.0
SAMPLE = 8192
BLOCK = 2048
GROUP = 64
NONE = -(1 << 62)  # below every score
POINT = "vec_id bigint, label int, vec binary, norm double, peak bigint"


# --- vectors ---------------------------------------------------------------------------

def quantised(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vec, norm, peak): vec is floor(scale * x) as little-endian 32-bit integers, norm its squared norm,
    peak its largest component."""
    def work(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            good = np.isfinite(x)
            bad = np.bincount(np.repeat(np.arange(len(size)), size)[~good], minlength=len(size)) > 0
            q = np.clip(np.floor(scale * np.where(good, x, 0.0)), -2.0 ** 30, 2.0 ** 30).astype("<i4")
            ends = np.concatenate(([0], 4 * np.cumsum(size)))
            vec = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(q.tobytes())])
            row = np.repeat(np.arange(len(size)), size)
            norm = np.bincount(row, q.astype(np.float64) ** 2, len(size))
            peak = np.zeros(len(size), np.int64)
            np.maximum.at(peak, row, np.abs(q.astype(np.int64)))
            out = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), vec, pa.array(norm, pa.float64()), pa.array(peak)], names=["vec_id", "label", "vec", "norm", "peak"])
            yield out.filter(pa.array(~bad))

    known = rows.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("int"), F.col(vec_col).cast("array<double>"))
    return known.dropna().mapInArrow(work, POINT)


def matrix(vecs: list[bytes], dims: int) -> np.ndarray:
    """Rows of equal length from vectors of at most ``dims`` components."""
    if all(len(v) == 4 * dims for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), dims)
    out = np.zeros((len(vecs), dims), "<i4")
    for row, v in zip(out, vecs):
        row[:len(v) // 4] = np.frombuffer(v, "<i4")
    return out


class Space(NamedTuple):
    """What all tasks must agree on."""

    dims: int
    largest: float  # norm
    peak: int  # largest component

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact integer inner products of all rows."""
        kind = np.float64 if self.peak * self.peak * max(self.dims, 1) < 2 ** 53 else np.int64
        return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)

    def augmented(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(np.float64)
        more = np.sqrt(np.maximum(self.largest ** 2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate((x, more[:, None]), axis=1)


# --- trees -----------------------------------------------------------------------------

class Tree(NamedTuple):
    """Nodes in breadth-first order; node k's children are nodes[below[k]:below[k + 1]]."""

    point: np.ndarray  # place of the node's vector
    angle: np.ndarray  # no vector below lies at a larger angle from the node's
    fresh: np.ndarray  # False where the parent is the same vector
    below: np.ndarray


def build(x: np.ndarray, largest: float) -> Tree:
    """Cover tree of augmented vectors (at most a few thousand)."""
    n = len(x)
    norms = (x * x).sum(axis=1)
    apart = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0.0))
    apart[apart < 0.5] = 0.0  # components are integers
    root = int(np.argmin(apart.max(axis=1))) if n else 0
    point, radius, fresh, below = [root], [], [True], []
    waiting = [np.delete(np.arange(n), root)]
    k = 0
    while k < len(waiting):
        centre, rest = point[k], waiting[k]
        below.append(len(point))
        far = float(apart[centre, rest].max()) if len(rest) else 0.0
        radius.append(far)
        if len(rest):
            reach = far / LEVELS
            near = apart[centre, rest] <= reach if far > 0 else np.zeros(len(rest), bool)
            if near.any():
                point.append(centre)
                fresh.append(False)
                waiting.append(rest[near])
                rest = rest[~near]
            while len(rest):
                c = int(rest[0])
                rest = rest[1:]
                near = apart[c, rest] <= reach if far > 0 else np.zeros(len(rest), bool)
                point.append(c)
                fresh.append(True)
                waiting.append(rest[near])
                rest = rest[~near]
        k += 1
    below.append(len(point))
    chord = np.minimum((np.array(radius) + 1e-6 * max(largest, 1.0)) / (2 * max(largest, 1e-300)), 1.0)
    return Tree(np.array(point), np.where(np.array(radius) > 0, 2 * np.arcsin(chord), 0.0), np.array(fresh), np.array(below))


PART = "tree bigint, n bigint, points binary, labels binary, ids binary, counts binary, node binary, angle binary, fresh binary, below binary"


def _packed(tree: int, ids: list[list[int]], labels: np.ndarray, q: np.ndarray, t: Tree) -> list:
    return [
        tree, len(ids), q.astype("<i4").tobytes(), labels.astype("<i4").tobytes(), np.array([i for x in ids for i in x], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<i4").tobytes(), t.point.astype("<i4").tobytes(), t.angle.astype("<f8").tobytes(),
        t.fresh.astype("u1").tobytes(), t.below.astype("<i4").tobytes()]


class Part(NamedTuple):
    """One tree and its vectors as a task reads them."""

    q: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    tree: Tree

    @classmethod
    def read(cls, row: list, dims: int) -> Part:
        n, points, labels, ids, counts, node, angle, fresh, below = row
        size = np.frombuffer(counts, "<i4").astype(np.int64)
        return cls(
            np.frombuffer(points, "<i4").reshape(n, dims), np.frombuffer(labels, "<i4"), np.frombuffer(ids, "<i8"), np.cumsum(size) - size, size,
            Tree(np.frombuffer(node, "<i4"), np.frombuffer(angle, "<f8"), np.frombuffer(fresh, "u1").astype(bool), np.frombuffer(below, "<i4")))


def forest(points: DataFrame, space: Space, keep: int, cells: int | None = None) -> DataFrame:
    """Cover trees of all points: rows of ``PART``, written to the shared folder."""
    spark = points.sparkSession
    alike = Window.partitionBy("vec", "label").orderBy("vec_id")
    kept = points.withColumn("k", F.row_number().over(alike)).where(F.col("k") <= keep)
    alone = common.stored(kept.groupBy("vec", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    count = alone.count()
    cells = cells or max(1, min(1024, count // (TREE // 2)))
    # centres: a bounded sample by hash order, thinned to vectors far from each other
    sample = alone.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow().column(0).to_pylist()
    centres = spread(space.augmented(matrix(sample, space.dims)), cells) if sample else np.zeros((1, space.dims + 1))

    def place(batches):
        for b in batches:
            x = space.augmented(matrix(b.column(1).to_pylist(), space.dims))
            cell = np.argmax(x @ centres.T, axis=1)  # all have one norm, so the nearest has the largest product
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    placed = common.stored(alone.select("label", "vec", "ids").mapInArrow(place, "label int, vec binary, ids array<bigint>, cell int"), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / TREE).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn(  # a row per cell, at most 1,024
        "tree", F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("vec", "label"), F.col("parts")))

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        q = matrix(group.column("vec").to_pylist(), space.dims)
        labels = group.column("label").to_numpy()
        row = _packed(group.column("tree")[0].as_py(), group.column("ids").to_pylist(), labels, q, build(space.augmented(q), space.largest))
        return pa.table({f.split()[0]: pa.array([v], pa.int64() if "bigint" in f else pa.binary()) for f, v in zip(PART.split(", "), row)})

    return common.stored(dealt.select("tree", "label", "vec", "ids").groupBy("tree").applyInArrow(grow, PART), "trees")


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each farthest from those before it."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)):
        k = int(np.argmax(gap))
        if gap[k] <= 0:
            break
        chosen.append(k)
        gap = np.minimum(gap, ((x - x[k]) ** 2).sum(axis=1))
    return x[chosen]


# --- search ----------------------------------------------------------------------------

class Best:
    """The ``k`` best (score, id) of each window; window w belongs to anchor ``anchor[w]`` and holds scores low..high."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.score = np.full((len(anchor), k), NONE)
        self.id = np.full((len(anchor), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """No score below this enters a window."""
        return np.maximum(self.low, self.score[:, -1])

    def offer(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        touched, place = np.unique(window, return_inverse=True)
        w = np.concatenate((np.repeat(np.arange(len(touched)), self.k), place))
        s = np.concatenate((self.score[touched].ravel(), score))
        i = np.concatenate((self.id[touched].ravel(), ids))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        top = rank < self.k
        self.score[touched[w[top]], rank[top]], self.id[touched[w[top]], rank[top]] = s[top], i[top]


class Anchors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray


def search(part: Part, anchors: Anchors, best: Best, same: bool, space: Space) -> None:
    """Offer every candidate of a tree that can enter a window: of the anchor's label, its own row apart, or of others.

    ``best`` has at least one window for each anchor, in the anchors' order.
    """
    t, reach = part.tree, np.linalg.norm(anchors.q.astype(np.float64), axis=1) * space.largest
    begin = np.searchsorted(best.anchor, np.arange(len(anchors.ids)))
    windows = np.diff(np.append(begin, len(best.anchor)))

    def span(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that any window of these anchors takes."""
        return np.minimum.reduceat(best.floor(), begin)[who], np.maximum.reduceat(best.high, begin)[who]

    def offer(who: np.ndarray, first: int, last: int, score: np.ndarray) -> None:
        node = t.point[first:last]
        low, high = span(who)
        fits = ((part.labels[node][None, :] == anchors.labels[who][:, None]) == same) & t.fresh[first:last][None, :]
        row, col = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
        if not len(row):
            return
        # each hit against each window of its anchor, then each row of an equal vector
        per = windows[who[row]]
        w = np.repeat(begin[who[row]] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        hit, p = np.repeat(score[row, col], per), np.repeat(node[col], per)
        inside = (hit >= best.floor()[w]) & (hit <= best.high[w])
        w, hit, p = w[inside], hit[inside], p[inside]
        many = part.counts[p]
        ids = chunks.gathered(part.ids, part.first[p], many)
        w, hit = np.repeat(w, many), np.repeat(hit, many)
        other = ids != anchors.ids[best.anchor[w]]
        best.offer(w[other], hit[other], ids[other])

    def visit(who: np.ndarray, first: int, last: int) -> list:
        """Score nodes first..last for some anchors; gives the nodes worth descending, each with its anchors and bounds."""
        score = space.products(anchors.q[who], part.q[t.point[first:last]])
        offer(who, first, last, score)
        inner = np.nonzero(np.diff(t.below[first:last + 1]) > 0)[0]
        if not len(inner):
            return []
        turn = np.arccos(np.clip(score[:, inner] / np.maximum(reach[who], 1e-300)[:, None], -1.0, 1.0))
        wide, slack = t.angle[first:last][inner][None, :], 1.0 + 1e-9 * reach[who][:, None]
        upper = reach[who][:, None] * np.cos(np.maximum(turn - wide, 0.0)) + slack
        lower = reach[who][:, None] * np.cos(np.minimum(turn + wide, math.pi)) - slack
        out = []
        for j, n in enumerate(inner.tolist()):
            out += worth(first + n, who, upper[:, j], lower[:, j])
        return out

    def worth(k: int, who: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> list:
        low, high = span(who)
        wanted = (upper >= low) & (lower <= high)
        # a node's number breaks ties, so the arrays are never compared
        return [(-float(upper[wanted].max()), k, who[wanted], upper[wanted], lower[wanted])] if wanted.any() else []

    queue = visit(np.arange(len(anchors.ids)), 0, 1)
    heapq.heapify(queue)
    while queue:
        _, k, who, upper, lower = heapq.heappop(queue)
        for _, _, who, _, _ in worth(k, who, upper, lower):  # windows may have closed since it was queued
            for item in visit(who, int(t.below[k]), int(t.below[k + 1])):
                heapq.heappush(queue, item)


# --- jobs ------------------------------------------------------------------------------

FOUND = "anchor_id bigint, key bigint, other_id bigint, key_score bigint, score bigint"


def searched(blocks: DataFrame, trees: DataFrame, space: Space, k: int, same: bool, low: int) -> DataFrame:
    """Rows of ``FOUND``: the k best of every window, per block of anchors and group of trees.

    ``blocks`` has (block, vec_id, label, vec, keys): keys is the list of (positive score, positive id) whose windows are
    wanted; an anchor with a null list has one window that takes every score.
    """
    spark = trees.sparkSession
    n_blocks, n_trees = blocks.agg(F.max("block")).first()[0], trees.count()
    if n_blocks is None or not n_trees:
        return spark.createDataFrame([], FOUND)
    n_blocks += 1
    cores = spark.sparkContext.defaultParallelism
    groups = max(-(-n_trees // GROUP), min(n_trees, -(-2 * cores // n_blocks)))
    spots = min(n_blocks * groups, 8192)
    numbered = trees.withColumn("grp", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
    left = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(spots, "block", "grp")
    right = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(spots, "block", "grp")
    names = [f.split()[0] for f in PART.split(", ")][1:]

    def work(found: pa.Table, group: pa.Table) -> pa.Table:
        if not found.num_rows or not group.num_rows:
            return pa.table({f.split()[0]: pa.array([], pa.int64()) for f in FOUND.split(", ")})
        found = found.combine_chunks().sort_by("vec_id")
        anchors = Anchors(found.column("vec_id").to_numpy(), found.column("label").to_numpy(), matrix(found.column("vec").to_pylist(), space.dims))
        keys = found.column("keys").to_pylist()
        flat = [(row, *((x["score"], x["id"]) if x else (None, None))) for row, some in enumerate(keys) for x in (some or [None])]
        owner = np.array([f[0] for f in flat])
        score = np.array([f[1] or 0 for f in flat], np.int64)
        if same:
            best = Best(owner, np.full(len(flat), NONE), np.full(len(flat), -NONE), k)
        else:
            best = Best(owner, -(-low * score // 100), score, k)
        # the tree whose root is nearest to the anchors comes first, so that the others meet narrow windows
        parts = [Part.read([row[c] for c in names], space.dims) for row in group.select(names).to_pylist()]
        middle = anchors.q.astype(np.float64).mean(axis=0)
        for part in sorted(parts, key=lambda p: -float(p.q[p.tree.point[0]] @ middle)):
            search(part, anchors, best, same, space)
        w, slot = np.nonzero(best.score > NONE)
        key = np.array([f[2] or 0 for f in flat], np.int64)
        columns = anchors.ids[owner[w]], key[w], best.id[w, slot], score[w], best.score[w, slot]
        return pa.table({f.split()[0]: pa.array(c) for f, c in zip(FOUND.split(", "), columns)})

    return left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(work, FOUND)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id.
    """
    one = quantised(rows, scale).groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm", "peak")).alias("r"))
    points = common.stored(one.select("vec_id", "r.*"), "points")
    size = points.agg(F.max(F.octet_length("vec")), F.max("norm"), F.max("peak"), F.count(F.when(is_anchor, 1))).first()
    space = Space((size[0] or 0) // 4, math.sqrt(size[1] or 0.0) * (1 + 1e-9), size[2] or 0)
    trees = forest(points.select("vec_id", "label", "vec"), space, max(positives + 1, negatives))
    n_blocks = max(1, -(-size[3] // BLOCK))
    anchors = points.where(is_anchor).select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), "vec_id", "label", "vec")
    keyed = "array<struct<score:bigint,id:bigint>>"
    near = searched(anchors.withColumn("keys", F.lit(None).cast(keyed)), trees, space, positives, True, low)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    best = common.stored(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives), "positives")
    keys = best.groupBy("anchor_id").agg(F.collect_list(F.struct("score", F.col("other_id").alias("id"))).alias("keys"))
    wanted = anchors.join(keys.withColumnRenamed("anchor_id", "vec_id"), "vec_id")  # without positives there is nothing to mine
    found = searched(wanted.select("block", "vec_id", "label", "vec", "keys"), trees, space, negatives, False, low)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "other_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"),
        F.col("key_score").alias("positive_score"), F.col("score").alias("negative_score"))


@common.query("op11_hardneg", sql="""
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS "rank",
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
""")
def op11(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
