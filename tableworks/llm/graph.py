"""Connected components of links as joins and aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Links that one task reduces at most.
EDGES = 200_000


def _stars(batches, centres: bool = False):
    """The links of one task as one star per component of theirs: no more links than nodes go on from here. ``centres`` are put out
    too, linked with themselves."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if centres or find(x) != x]
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (columns a, b) the smallest id reachable from it.

    Each task first reduces its links to stars. Each round points every node at its smallest neighbour, jumps once over the pointers and merges the nodes that meet, so the
    number of nodes with links falls geometrically. Nothing is collected: rounds end when no link is left.
    A hub's links are aggregated before they are shuffled; its joins are split by adaptive execution. Null ends and self links
    are ignored.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links"
    )
    result, rounds = None, 0
    while n := edges.count():
        few = 1 + n // EDGES  # tasks of a round, in proportion to its links
        if few == 1:  # one task sees all that is left: its stars are the components
            roots = stored(edges.coalesce(1).mapInArrow(lambda batches: _stars(batches, centres=True), "a long, b long"), "stars")
            result = _step(result, roots.select(F.col("b").alias("node"), F.col("a").alias("root")))
            break
        edges = stored(edges.coalesce(few).mapInArrow(_stars, "a long, b long"), "stars")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        jump = parent.select(F.col("a").alias("p"), F.col("p").alias("root"))
        roots = stored(parent.join(jump, "p").select(F.col("a").alias("node"), "root").coalesce(few), "roots")
        ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = stored(moved.coalesce(few), "links")
        result = _step(result, roots)
        rounds += 1
        if rounds % 4 == 0:
            result = stored(result, "components")
    if result is None:
        return links.sparkSession.createDataFrame([], "id long, component long")
    return result if rounds == 0 else stored(result, "components")


def _step(result: DataFrame | None, roots: DataFrame) -> DataFrame:
    """The components so far, moved on to the roots of a round."""
    if result is None:
        return roots.select(F.col("node").alias("id"), F.col("root").alias("component"))
    step = roots.select(F.col("node").alias("component"), F.col("root").alias("next"))
    return result.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
