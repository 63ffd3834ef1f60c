"""Connected components of a graph of long ids, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdom.llm.common import drop_table, materialize

#: Nodes that a task joins up in memory before it passes on what it has.
NODES = 1 << 18


class Forest:
    """Union-find that keeps the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        root = a
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[a] != root:
            up[a], a = root, up[a]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """An edge from each member to its root, which links the same nodes as what went in."""
        edges = [(a, r) for a in list(self.up) if (r := self.find(a)) != a]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([r for _, r in edges], pa.int64())], ["u", "v"])


def stars(links: Iterable[tuple[Iterable[int], Iterable[int]]]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for us, vs in links:
        for u, v in zip(us, vs, strict=True):
            forest.join(u, v)
        if len(forest.up) > NODES:
            yield forest.stars()
    if forest.up:
        yield forest.stars()


def shrink(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stars((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(spark: SparkSession, edges: DataFrame, shrunk: bool = False) -> DataFrame:
    """(node, root): every node of edges (u, v) with the smallest node that it is linked to.

    Each round hangs every node below its smallest neighbour, follows that twice and
    contracts the graph, until no edge is left; the rounds grow with the logarithm of the
    components' size. Only what a round leaves is written. shrunk says that edges are
    stars already; a second pass in Python would take two workers for each task.
    """
    edges, path = materialize(spark, edges if shrunk else shrink(edges), "edges")
    labels, labels_path = None, None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        up, up_path = materialize(spark, up, "up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        top = up.join(over, "up").select("node", F.col("up2").alias("root"))
        top, top_path = materialize(spark, top, "top")
        drop_table(spark, up_path)
        at_u, at_v = top.select(F.col("node").alias("u"), F.col("root").alias("ru")), top.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = edges.join(at_u, "u").join(at_v, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        rest, rest_path = materialize(spark, shrink(left), "edges")
        drop_table(spark, path)
        edges, path = rest, rest_path
        if labels is None:
            labels, labels_path = top, top_path
        else:
            moved = labels.join(top.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            new, new_path = materialize(spark, moved, "labels")
            drop_table(spark, labels_path)
            drop_table(spark, top_path)
            labels, labels_path = new, new_path
    drop_table(spark, path)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")
