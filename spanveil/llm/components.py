"""Connected components by alternating large-star and small-star steps over DataFrames of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: So many edges at most are joined by one task instead of in rounds, each of which plans several exchanges on the driver.
AT_ONCE = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest of the node and its neighbours."""
    near = _both_ways(edges)
    least = written(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), "least")
    return near.join(least, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is joined to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = written(down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "least")
    moved = down.join(least, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all edges (a, b) every node but the roots, with its root: roots are hung on the least root that an edge leads to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x for side in zip(*held) for x in side]), return_inverse=True)
    one, two = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[one] != root[two]).any():
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(root[one], root[two]), np.minimum(root[one], root[two]))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["a", "root"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(a, root) for every node of the edges (a, b) but the roots themselves; a root is its component's least node.

    Up to ``at_once`` edges between numbers are joined by one task, with the same result; more go in rounds.
    Each round is written to the shared folder. Nodes of any degree are fine: only minima are gathered per node, and they
    are read from a table, so that adaptive execution can split a node's edges in the join with them.
    """

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = state(edges)
    if before[0] <= at_once and {kind for _, kind in edges.dtypes} == {"bigint"}:
        return written(edges.coalesce(1).mapInArrow(_joined, "a bigint, root bigint"), "roots")
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            return edges.select("a", F.col("b").alias("root"))
        before = now
