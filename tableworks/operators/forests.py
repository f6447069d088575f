"""Forests of many sizes and depths from one grown forest.

The trees of a random forest are drawn independently and grown greedily from the top. So the first n trees of a larger forest are a
forest of n trees, and a tree cut at a depth is the tree grown to that depth from the same draws. The forests of a search that differ in
number of trees and depth alone come from one fit; each other parameter (the size of a leaf) gets a fit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


#: Bytes a core may keep of the nodes that rows have reached, four per row and tree.
NODE_ID_BYTES = 400 << 20


def with_node_ids(forest, rows: DataFrame):
    """The forest set to keep the node that each row has reached in each tree, where these fit: rows then do not fall through all trees
    from the top again at every level. The trees grown are the same. Levels are few, so what is kept needs no checkpoint."""
    if rows.count() * forest.getNumTrees() * 4 > NODE_ID_BYTES * rows.sparkSession.sparkContext.defaultParallelism:
        return forest
    return forest.copy({forest.cacheNodeIds: True, forest.checkpointInterval: -1})


@dataclass
class Nodes:
    """All trees of a forest, node by node in preorder: the children (-1 at a leaf), level and prediction of each, and what it adds to
    the forest's vote (class shares, or the value). ``roots`` and ``leaves`` say where each tree's nodes and leaves start."""

    left: np.ndarray
    right: np.ndarray
    level: np.ndarray
    prediction: np.ndarray
    vote: np.ndarray
    roots: np.ndarray
    leaf: np.ndarray
    leaves: np.ndarray

    def cut(self, depth: int) -> np.ndarray:
        """For each leaf the node where its path ends in the tree of that depth. As Spark does, two leaves that predict the same are one."""
        ends, end = (self.left < 0) | (self.level >= depth), np.arange(len(self.left))
        for level in range(min(depth, int(self.level.max(initial=0))) - 1, -1, -1):
            at = np.flatnonzero((self.level == level) & ~ends)
            l, r = self.left[at], self.right[at]
            ends[at] = ends[l] & ends[r] & (self.prediction[l] == self.prediction[r])
        for level in range(int(self.level.max(initial=0))):
            at = np.flatnonzero((self.level == level) & (self.left >= 0))
            for child in (self.left[at], self.right[at]):
                end[child] = np.where(ends[end[at]], end[at], child)
        return end[self.leaf]


def read_nodes(model, classes: bool) -> Nodes:
    """The nodes of a fitted forest from its stored form. Their number is bounded by trees and depth, not by the rows."""
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    t = stored.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild").toArrow()
    tree, own = t.column("treeID").to_numpy(), t.column("id").to_numpy()
    order = np.lexsort((own, tree))
    tree = tree[order]
    roots = np.searchsorted(tree, np.arange(int(tree[-1]) + 2))

    def child(name: str) -> np.ndarray:
        c = t.column(name).to_numpy()[order].astype(np.int64)
        return np.where(c >= 0, c + roots[tree], -1)

    left, right, prediction = child("leftChild"), child("rightChild"), t.column("prediction").to_numpy()[order]
    level, at = np.zeros(len(left), np.int64), roots[:-1]
    while len(at):
        inner = at[left[at] >= 0]
        below = np.concatenate((left[inner], right[inner]))
        level[below] = np.concatenate((level[inner], level[inner])) + 1
        at = below
    if classes:
        stats = np.array(t.column("impurityStats").to_pylist(), np.float64)[order]
        total = stats.sum(1, keepdims=True)
        vote = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    else:
        vote = prediction[:, None]
    leaf = np.flatnonzero(left < 0)
    return Nodes(left, right, level, prediction, vote, roots, leaf, np.searchsorted(leaf, roots))


def nested_predictions(model, sizes: list[tuple[int, int]], rows: DataFrame, label: str, classes: bool) -> DataFrame:
    """(label, predictions): of every forest (trees, depth) that ``model`` holds, in the order of ``sizes``."""
    nodes = read_nodes(model, classes)
    cuts = {depth: nodes.cut(depth).astype(np.int32) for _, depth in sizes}
    shared = rows.sparkSession.sparkContext.broadcast((cuts, nodes.vote, nodes.leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, vote, leaves = shared.value
        for batch in batches:
            n = batch.num_rows
            at = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(n, len(leaves) - 1) + leaves[:-1]
            out = np.zeros((n, len(sizes)))
            for depth, cut in cuts.items():
                votes = np.zeros((n, vote.shape[1]))
                for tree in range(max(t for t, d in sizes if d == depth)):
                    votes += vote[cut[at[:, tree]]]
                    for i, size in enumerate(sizes):
                        if size == (tree + 1, depth):
                            out[:, i] = votes.argmax(1) if classes else votes[:, 0] / (tree + 1)
            told = pa.ListArray.from_arrays(np.arange(0, n * len(sizes) + 1, len(sizes), dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), told], names=[label, "predictions"])

    fallen = model.copy().setLeafCol("leaf").transform(rows).select(F.col(label).cast("double").alias(label), vector_to_array("leaf").alias("leaf"))
    return fallen.mapInArrow(run, f"`{label}` double, predictions array<double>")


def validated_forests(
    fit_rows: DataFrame, check_rows: DataFrame, estimators: list, label: str, classes: bool
) -> tuple[list[DataFrame], list[DataFrame]]:
    """For every forest to be tried (label, prediction) over ``check_rows``, and the tables cached for them. Forests with equal leaf
    sizes share one fit."""
    out: list[DataFrame | None] = [None] * len(estimators)
    cached = []
    for least in sorted({e.getMinInstancesPerNode() for e in estimators}):
        same = [i for i, e in enumerate(estimators) if e.getMinInstancesPerNode() == least]
        sizes = [(estimators[i].getNumTrees(), estimators[i].getMaxDepth()) for i in same]
        widest = estimators[same[0]].copy().setNumTrees(max(t for t, _ in sizes)).setMaxDepth(max(d for _, d in sizes))
        found = nested_predictions(with_node_ids(widest, fit_rows).fit(fit_rows), sizes, check_rows, label, classes).persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(found)
        for place, i in enumerate(same):
            out[i] = found.select(label, F.col("predictions")[place].alias("prediction"))
    return out, cached
