"""Connected components by hashed hooking and contraction, as joins and aggregations; one task settles a bounded rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, written

#: Edges that one task settles: 16 bytes each, so 8 MB. More are contracted first, in rounds.
ONE_TASK = 1 << 19


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node connected with each of n nodes.

    Roots hook onto smaller neighbours, then pointers jump to the roots. Of the roots that still
    have an edge to another at most half stay, so that rounds are logarithmic.
    """
    low = np.arange(n)
    while len(i):
        a, b = low[i], low[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := low[low], low):
            low = up
    return low


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, p): each node of a task's edges and the smallest node it is connected with."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([x for pair in zip(*parts) for x in pair])
    nodes, at = np.unique(ends, return_inverse=True)
    half = len(ends) // 2
    root = nodes[forest(len(nodes), at[:half], at[half:])]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["x", "p"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Label the nodes of an undirected graph.

    edges(src long, dst long) may hold loops, repeats and nulls (such rows link nothing). Returns
    one row (node, root) per node with an edge to another node; two nodes have the same root
    exactly if they are connected. The root is some node of the component. No edges, no rows.

    While there are more than one_task edges, every remaining node hooks to the neighbour that a
    hash of the round ranks first, if it ranks before the node itself, pointers jump twice, and the
    edges are relabelled and deduplicated. Random ranks keep the pointer chains short, so that the
    edges left shrink geometrically. Then one task, whose memory one_task bounds, settles the rest.
    Nothing is collected; a node with very many edges is met by partial aggregates and by joins of
    two plain exchanges, which adaptive execution splits.
    """
    spark = edges.sparkSession
    left = kept(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("src != dst").distinct())
    maps: list[DataFrame] = []
    while (n := left.count()) > one_task:
        rank = F.xxhash64(F.lit(len(maps)), F.col("y"))
        both = left.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(left.select(F.col("b").alias("x"), F.col("a").alias("y")))
        own = F.struct(F.xxhash64(F.lit(len(maps)), F.col("x")).alias("h"), F.col("x").alias("y"))
        best = both.groupBy("x").agg(F.min(F.struct(rank.alias("h"), F.col("y"))).alias("n")).select("x", F.least("n", own)["y"].alias("p"))
        hook = written(best, "hook")
        for _ in range(2):
            above = hook.select(F.col("x").alias("p"), F.col("p").alias("q"))
            hook = written(hook.join(above, "p").select("x", F.col("q").alias("p")), "hook")
        maps.append(hook)
        to_a = hook.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        to_b = hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("pa != pb")
        left = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if n:
        maps.append(kept(left.coalesce(1).mapInArrow(_settle, "x long, p long")))
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    labels = maps[0].select(F.col("x").alias("node"), F.col("p").alias("root"))
    for hook in maps[1:]:
        up = hook.select(F.col("x").alias("root"), F.col("p").alias("up"))
        labels = written(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    return labels
