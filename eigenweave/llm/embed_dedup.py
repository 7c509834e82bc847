"""Embedding near-duplicates by tiled comparison in principal-component order.

Equal vectors of a label form a class first; classes are compared, and counted by their sizes. The
classes of a label are cut into strips along the first principal component and the strips into
blocks of bounded bytes; a tile is a pair of blocks whose strips come near enough for the threshold
(unit vectors with cosine c are sqrt(2 - 2c) apart, and no more along any axis). A vector is shuffled
once for each tile it is in, so blocks are as large as memory allows, and a tile takes its rows in
order of the first component and INNER at a time, again only where they come near. There, products
are accumulated over the leading components first. After each step the rest of a product is at
most the product of the two suffix norms; pairs that cannot reach the threshold any more drop out,
and a tile stops when none is left. What remains is checked in the original coordinates in double
precision.

A tile returns counts by class and a spanning forest of its links, never the pairs: its output is
linear in its blocks. The basis is fitted on a sample of at most SAMPLE vectors, chosen by hash;
it is orthogonal, so it decides speed only: every vector is compared, and none by approximation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_input, kept, written
from .components import connected_components, forest

SAMPLE, STRIPS = 4096, 1024
#: Bytes and rows of a block at most, and rows compared at once.
BLOCK_BYTES, BLOCK, INNER = 8 << 20, 8192, 2048
#: Components after which products are bounded, and the share of pairs below which single pairs are followed.
STEPS, SPARSE = (8, 16, 32, 64, 128, 256, 512), 0.02
SLACK = 1e-9


def basis(sample: np.ndarray) -> np.ndarray:
    """Columns: principal axes of the rows' unit vectors, by falling variance."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, ::-1]


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows of a and b with cosine >= threshold; i < j if both are the same block."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    pa_, pb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    d = pa_.shape[1]
    cuts = [*(s for s in STEPS if s < d), d]
    tail = lambda p, k: np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p[:, :k], p[:, :k])))
    dots, i, j, at = None, None, None, 0
    for k in cuts:
        if i is None:
            step = pa_[:, at:k] @ pb[:, at:k].T
            dots = step if dots is None else dots + step
            alive = dots + np.outer(tail(pa_, k), tail(pb, k)) >= threshold - SLACK
            if same:
                alive = np.triu(alive, 1)
            n = np.count_nonzero(alive)
            if n <= SPARSE * alive.size or k == d:
                i, j = np.nonzero(alive)
                dots = dots[i, j]
        else:
            dots = dots + np.einsum("ij,ij->i", pa_[i, at:k], pb[j, at:k])
            alive = dots + tail(pa_, k)[i] * tail(pb, k)[j] >= threshold - SLACK
            i, j, dots = i[alive], j[alive], dots[alive]
        at = k
        if i is not None and not len(i):
            break
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 18):
        x, y = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
        keep[s : s + (1 << 18)] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
    return i[keep], j[keep]


def tile_links(a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a, then b (a alone if same): the weight of the rows they link with, and edges (i, j) that connect what links connect.

    Links are counted as they are found and edges kept as a forest, so memory is that of INNER rows'
    products whatever the number of links.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    place = lambda v: (v @ axes[:, 0]) / np.linalg.norm(v, axis=1)
    pa_ = place(a)
    order_a = np.argsort(pa_, kind="stable")
    pb, order_b = (pa_, order_a) if same else (pb := place(b), np.argsort(pb, kind="stable"))
    base = 0 if same else len(a)
    total, edges = np.zeros(len(a) + (0 if same else len(b))), []
    for s in range(0, len(a), INNER):
        left = order_a[s : s + INNER]
        for t in range(s if same else 0, len(b), INNER):
            right = order_b[t : t + INNER]
            if max(pb[right[0]] - pa_[left[-1]], pa_[left[0]] - pb[right[-1]]) > reach:
                continue
            diagonal = same and s == t
            i, j = linked_pairs(a[left], b[right], axes, threshold, diagonal)
            if not len(i):
                continue
            total[left] += np.bincount(i, weight_b[right[j]], len(left))
            total[base + right] += np.bincount(j, weight_a[left[i]], len(right))
            ends = np.concatenate((left, base + right))
            low = forest(len(ends), *((i, j) if diagonal else (i, len(left) + j)))
            if diagonal:
                low = np.concatenate((low[: len(left)], low[: len(right)]))
            on = np.flatnonzero(low != np.arange(len(ends)))
            edges.append((ends[on], ends[low[on]]))
    i, j = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, int), np.zeros(0, int))
    return total, i, j


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int | None = None) -> DataFrame:
    """(id, n_links long, component_id, kept boolean) for each row of vectors.

    Vectors are linked if their labels are equal and not null, their lengths are equal and their
    cosine is at least threshold. Null, empty and zero vectors and such with null or non-finite
    components link with nothing. n_links counts other rows, equal vectors included; component_id
    is the smallest id that links reach, kept says whether it is the row's own. Rows may repeat an
    id or have none: such a row links like any other, but names no component. Other columns are
    left aside, whatever their names. An empty table gives an empty table.
    """
    check_input(vectors, id_col, vector_col, label_col)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.select("id", "label", F.when(good, F.col("v")).alias("v"))
    rows = rows.select("id", "label", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), "v")
    key = ["label", "dim", "k1", "k2"]
    classes = rows.where("v is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    plain = rows.select("id", F.col("v").isNotNull().alias("good"), *key)
    dims = [r["dim"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(1).collect()]
    if not dims:
        return vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.where(F.col("dim") == dims[0]).orderBy(F.xxhash64("c")).limit(SAMPLE).select("v").collect()
    axes = basis(np.array([r["v"] for r in sample]))

    block = block or max(256, min(BLOCK, BLOCK_BYTES // (8 * dims[0])))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    along = F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, axes[:, 0]))), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / norm
    group = ["label", "dim"]
    placed = classes.select("c", "n", "v", *group, along.alias("p"))
    cuts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("all"), F.percentile_approx("p", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("cuts"))
    strips = F.least(F.lit(STRIPS), F.ceil(F.col("all") / block))
    placed = placed.join(kept(cuts), group).withColumn("strip", F.floor(F.size(F.filter("cuts", lambda x: x < F.col("p"))) * strips / STRIPS)).drop("all", "cuts")
    counts = kept(placed.groupBy(*group, "strip").agg(F.ceil(F.count(F.lit(1)) / block).alias("subs")))
    placed = placed.join(counts, [*group, "strip"]).withColumn("sub", F.pmod(F.xxhash64("c"), "subs"))
    placed = written(placed.select("c", "n", "v", "p", *group, "strip", "sub"), "placed")

    blocks = placed.groupBy(*group, "strip", "sub").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    blocks = kept(blocks.withColumn("b", F.monotonically_increasing_id()))
    left, right = (blocks.select(*group, *(F.col(c).alias(f"{c}{s}") for c in ("strip", "sub", "lo", "hi", "b"))) for s in (1, 2))
    ordered = (F.col("strip1") < F.col("strip2")) | ((F.col("strip1") == F.col("strip2")) & (F.col("sub1") <= F.col("sub2")))
    near = F.col("lo2") - F.col("hi1") <= math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    tiles = kept(left.join(right, group).where(ordered & near).select("b1", "b2").withColumn("tile", F.monotonically_increasing_id()))
    member = placed.join(blocks.drop("lo", "hi"), [*group, "strip", "sub"]).select("b", "c", "n", "v")
    first = member.join(tiles.select(F.col("b1").alias("b"), "tile", (F.col("b1") == F.col("b2")).alias("same")), "b").withColumn("side", F.lit(0))
    second = member.join(tiles.where("b1 != b2").select(F.col("b2").alias("b"), "tile", F.lit(False).alias("same")), "b").withColumn("side", F.lit(1))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, same = rows[rows.side == 0], bool(rows.same.iloc[0])
        b = a if same else rows[rows.side == 1]
        va = np.stack(a.v.to_numpy())
        vb = va if same else np.stack(b.v.to_numpy())
        own = axes if axes.shape[0] == va.shape[1] else np.eye(va.shape[1])
        wa, wb = a.n.to_numpy(), b.n.to_numpy()
        links, i, j = tile_links(va, vb, wa, wb, own, threshold, same)
        c = a.c.to_numpy() if same else np.concatenate((a.c.to_numpy(), b.c.to_numpy()))
        low = forest(len(c), i, j)
        on = links > 0
        return pd.DataFrame({"c": c[on], "links": links[on].astype(np.int64), "root": c[low][on]})

    cols = ["tile", "same", "side", "c", "n", "v"]
    linked = written(first.select(cols).unionByName(second.select(cols)).groupBy("tile").applyInPandas(compare, "c long, links long, root long"), "linked")
    totals = linked.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("c").alias("src"), F.col("root").alias("dst")))
    named = classes.select("c", "rep", "n", *key).join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = written(named.join(totals, "c", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1), "named")
    least = kept(named.groupBy("root").agg(F.min("rep").alias("component")))
    known = written(named.join(least, "root").select(*key, "links", "component"), "known")
    out = plain.where("good").join(known, key).select("id", "links", "component")
    out = out.unionByName(plain.where("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
