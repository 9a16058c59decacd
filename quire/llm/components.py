"""Connected components by alternating large and small stars over a distributed edge list; of few edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_dead_shuffles, written


#: Edges up to which one task joins them in memory (a few dozen bytes each), which spares the rounds' shuffles. The result is the same.
ONE_TASK = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, ascending, and the smallest node that each reaches, by hooking and pointer jumping."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if parts:
            nodes, roots = smallest_reachable(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long").filter("node <> root"), "components")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones, or smaller ones and itself) to its smallest neighbour.

    The minimum is combined map-side and joined back, so a hub's neighbours never meet in one task's memory.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.filter(F.col("b") > F.col("a")) if large else both.unionByName(both.select("a", F.col("a").alias("b")))
    return out.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edge list (a, b) that reaches a smaller one, the smallest node that it reaches.

    Loops until the edges stay the same; each round is written to the shared folder, so that lineage stays
    short and a lost executor costs one round.
    """
    spark = edges.sparkSession
    edges = written(edges.filter(F.col("a") != F.col("b")).distinct(), "components")
    if edges.count() <= ONE_TASK:
        out = _in_one_task(edges)
        discard(edges)
        return out
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, old = mark, edges
        edges = written(_star(_star(old, True), False), "components")
        discard(old)
        drop_dead_shuffles(spark)
    # Now every edge goes from a node to its root.
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._quire_path = edges._quire_path  # for ``discard``
    return out
