"""Hard negatives by anchor-clustered shared lists: one list per cluster and block, walked by every anchor until it can stop.

Anchors are taken in groups of at most GROUP, so what is sent to the executors is bounded; a group's anchors are clustered
by direction. Every task streams its candidates in blocks. For a block and a cluster the candidates are sorted once by an
upper bound that holds for all anchors of the cluster: the candidate's length times the cosine of its angle to the
cluster's centre less the cluster's radius. Each anchor then walks that one list in strides of growing length, scores
exactly, and stops for certain once the bound of all that follows is below the least score that could still change
one of its results. What it has found so far goes on to the next block, so later walks end sooner.

There are two walks: over rows of the anchor's label for its positives, then, as these set the windows that scores of
negatives must lie in, over rows of other labels. A task returns no more than the wanted number per anchor and list, and
tasks are as many as the cluster has cores, so what is shuffled grows with the anchors alone. Scores are integers: vectors
are quantised first. All rows are scored or ruled out by a proven bound; no rows are sampled.

Work is anchors times candidates at worst; a group of anchors is one pass over the candidates.

Defined results: rows with a null id, a null label, a null vector or a null component take no part. Vectors of unequal
length count as filled up with zeros. Rows are compared by id: another row is one with another id, each repeated row
counts, and a repeated anchor has each result repeated. Fewer rows than wanted give all there are; no rows or no anchors,
an empty result. Scores beyond 2**53 raise. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Anchors a pass, anchors a cluster on average, candidates a block, and the first stride of a walk.
GROUP, CLUSTER, BLOCK, STRIDE = 8192, 64, 8192, 256
#: Scores that are worked out at once.
CELLS = 1 << 21
#: Rounding of bounds is covered by this much, relatively and in angles.
SLACK = 1e-6
#: Below every score.
NONE = np.iinfo(np.int64).min


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as integers; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


class Group:
    """Anchors with their clusters, and for each anchor its lists: how many are wanted and from which scores to which."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.length = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.members, self.centres, self.radius = _clusters(unit, max(1, len(ids) // CLUSTER))

    def lists(self, low: np.ndarray, high: np.ndarray, most: int, same: bool) -> Group:
        """low, high: (anchor, list) bounds of the scores that a list takes; `same`: rows of the anchor's label, else of others."""
        self.low, self.high, self.most, self.same = low, high, most, same
        return self


def _clusters(unit: np.ndarray, k: int, rounds: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Members, unit centres and greatest angles of k clusters by direction, from evenly spaced first centres."""
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-300)[:, None], centres)
    of = (unit @ centres.T).argmax(axis=1)
    members = [np.flatnonzero(of == c) for c in range(k)]
    angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
    return members, centres, np.array([angle[m, c].max(initial=0) for c, m in enumerate(members)])


class Walk:
    """The best rows so far of every anchor's lists, by score, then id."""

    def __init__(self, group: Group):
        self.g = group
        n, j = group.low.shape
        self.scores, self.ids = np.full((n, j, group.most), NONE), np.zeros((n, j, group.most), np.int64)
        self.walked = 0

    def floor(self, who: np.ndarray) -> np.ndarray:
        """The least score that could enter each list of these anchors."""
        return np.maximum(self.g.low[who], self.scores[who, :, -1])

    def block(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        g = self.g
        length = np.linalg.norm(vectors, axis=1)
        angles = np.arccos(np.clip(vectors @ g.centres.T / np.maximum(length, 1e-300)[:, None], -1, 1))
        for c, members in enumerate(g.members):
            if len(members):
                bound = length * np.cos(np.maximum(angles[:, c] - g.radius[c] - SLACK, 0))
                order = np.argsort(-bound, kind="stable")
                self._walk(members, bound[order], ids[order], labels[order], vectors[order])

    def _walk(self, who: np.ndarray, bound: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        at, stride = 0, STRIDE
        while at < len(ids):
            ceiling = self.g.length[who] * bound[at] * np.where(bound[at] > 0, 1 + SLACK, 1 - SLACK) + 1e-3
            who = who[ceiling >= self.floor(who).min(axis=1)]
            if not len(who):
                return
            stride = min(stride, max(1, CELLS // len(who)))
            part = slice(at, at + stride)
            scores = (self.g.vectors[who] @ vectors[part].T).astype(np.int64)
            self.walked += scores.size
            fit = ((labels[part][None, :] == self.g.labels[who][:, None]) == self.g.same) & (ids[part][None, :] != self.g.ids[who][:, None])
            floor = self.floor(who)
            for j in range(floor.shape[1]):
                hits = fit & (scores >= floor[:, j, None]) & (scores <= self.g.high[who, j, None])
                for i in np.flatnonzero(hits.any(axis=1)).tolist():
                    self._take(who[i], j, scores[i, hits[i]], ids[part][hits[i]])
            at, stride = at + stride, stride * 2

    def _take(self, a: int, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        all_scores, all_ids = np.concatenate([self.scores[a, j], scores]), np.concatenate([self.ids[a, j], ids])
        best = np.lexsort((all_ids, -all_scores.astype(np.float64)))[: self.g.most]
        self.scores[a, j], self.ids[a, j] = all_scores[best], all_ids[best]

    def rows(self) -> pa.RecordBatch:
        anchor, j, k = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(j), pa.array(self.ids[anchor, j, k]), pa.array(self.scores[anchor, j, k])], ["anchor", "slot", "id", "score"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros; what is longer than width meets zeros only and is left out."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _best(rows: DataFrame, group: Group) -> DataFrame:
    """(anchor, slot, id, score, rank) of the best rows of every list of the group's anchors, by score, then id."""
    boxed = rows.sparkSession.sparkContext.broadcast(group)  # at most GROUP anchors

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, width = Walk(boxed.value), boxed.value.vectors.shape[1]
        reach = max(float(np.abs(boxed.value.vectors).sum(axis=1).max()), 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = _matrix(part.column("vector"), width)
                if reach * np.abs(vectors).max(initial=0) >= 2**53:
                    raise ValueError("scores beyond 2**53: use a smaller scale")
                found.block(part.column("id").to_numpy(), part.column("label").to_numpy(), vectors)
        yield found.rows()

    slots = rows.sparkSession.sparkContext.defaultParallelism
    local = map_arrow(rows.coalesce(slots), walk, "anchor long, slot long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= group.most)


def _anchor_groups(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with a column `group` of at most about GROUP rows each, dealt out without a key."""
    n = max(1, -(-anchors.count() // GROUP))
    spread = n * max(1, anchors.sparkSession.sparkContext.defaultParallelism // n)
    return cut(anchors.repartition(spread).withColumn("group", F.spark_partition_id() % n)), n


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other labels.

    rows has id, label and vector (integers, see quantise). A score is the inner product with the anchor; higher scores come
    first, then smaller ids. A negative's score in hundredths of the positive's lies between low and high. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score, a row for each negative.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), is_anchor.alias("is_anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(F.forall("vector", lambda x: x.isNotNull()))
    anchors, n = _anchor_groups(rows.filter("is_anchor"))
    rows, parts = rows.select("id", "label", "vector"), []
    for k in range(n):
        own = anchors.filter(F.col("group") == k).select("id", "label", "vector").toArrow()  # at most about GROUP rows
        if not own.num_rows:
            continue
        vectors = own.column("vector").combine_chunks()
        width = int(np.asarray(vectors.value_lengths()).max())
        group = Group(own.column("id").to_numpy(), own.column("label").to_numpy(), _matrix(vectors, max(width, 1)))
        least = np.full((own.num_rows, 1), NONE + 1)
        found = _best(rows, group.lists(least, np.full_like(least, np.iinfo(np.int64).max), positives, True)).toArrow()  # `positives` an anchor
        anchor, rank = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
        score, of = np.zeros((own.num_rows, positives), np.int64), np.zeros((own.num_rows, positives), np.int64)
        score[anchor, rank], of[anchor, rank] = found.column("score").to_numpy(), found.column("id").to_numpy()
        bottom, top = -(-low * score // 100), high * score // 100
        void = bottom > top
        void |= np.bincount(anchor, minlength=own.num_rows)[:, None] <= np.arange(positives)
        bottom[void], top[void] = np.iinfo(np.int64).max, NONE  # takes nothing and never keeps a walk going
        best = cut(_best(rows, group.lists(bottom, top, negatives, False)))
        pairs = pa.table({"anchor": anchor, "slot": rank.astype(np.int64), "anchor_id": group.ids[anchor], "positive_id": of[anchor, rank], "positive_score": score[anchor, rank]})
        named = best.join(F.broadcast(spark.createDataFrame(pairs)), ["anchor", "slot"]) if pairs.num_rows else None
        if named is not None:
            parts.append(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionByName, parts) if parts else _empty(spark)
