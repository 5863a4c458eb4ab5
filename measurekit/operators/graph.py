"""Connected components by union-find inside partitions and star contractions between them, and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import join_salted
from ..session import cut

HELD_EDGES = 500_000     # edges a task contracts at a time
LOCAL_EDGES = 500_000    # edges that one task may finish


def least_labels(grp: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(grp, node, label)`` of every node of the edges that is not its component's least node."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    groups, of = np.unique(grp, return_inverse=True)
    own, at = np.unique(np.tile(of, 2) * len(nodes) + at, return_inverse=True)
    a, b = at[:len(src)], at[len(src):]
    up = np.arange(len(own))
    while len(a):
        lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = lo != hi
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(up, hi, lo)
        while (nxt := up[up]).tobytes() != up.tobytes():
            up = nxt
    moved = np.flatnonzero(up != np.arange(len(own)))
    return groups[own[moved] // len(nodes)], nodes[own[moved] % len(nodes)], nodes[own[up[moved]] % len(nodes)]


def _contracted(edges: DataFrame) -> DataFrame:
    """``grp, u, v``: inside each partition, an edge from every node to the least one it reaches there."""
    names = ["grp", "u", "v"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def labels() -> list[np.ndarray]:
            return list(least_labels(*(np.concatenate(c) for c in zip(*held))))

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        kinds = [pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            kinds = [c.type for c in b.columns]
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size > HELD_EDGES:
                held = [labels()]
                size = len(held[0][0])
                if size > HELD_EDGES // 2:
                    yield out(held[0])
                    held, size = [], 0
        if size:
            yield out(labels())
    return edges.mapInArrow(rows, edges.schema)


def components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """``(grp, node, component)`` for every node that has an edge; the label is the least node.

    ``edges`` has columns ``grp, src, dst``; groups are independent graphs. A union-find inside each partition leaves
    one edge per node and partition before anything is shuffled. Each round then contracts
    neighbourhoods onto their least node, so the number of rounds grows with the logarithm of the diameter; hubs are
    salted in the joins. Once at most ``local_edges`` are left, one task finishes them.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    e = edges.select("grp", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut(_contracted(e.filter("grp is not null and u <> v")).distinct())
    nodes = e.select("grp", F.col("u").alias("node")).union(e.select("grp", F.col("v").alias("node"))).distinct()
    mark = _mark(e)
    while mark[0] > local_edges:
        both = e.union(e.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
        e = cut(_contracted(_star(both, larger_only=True)).distinct())
        e = cut(_star(e, larger_only=False))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    if mark[0] <= local_edges:
        e = _contracted(e.coalesce(1))
    label = e.select("grp", F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(label, ["grp", "node"], "left").withColumn(
        "component", F.coalesce("component", "node"))


def _star(e: DataFrame, larger_only: bool) -> DataFrame:
    """Connect each node's neighbours (only the larger ones, or all) to its least neighbour."""
    least = e.groupBy("grp", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = join_salted(e, least, ["grp", "u"])
    if larger_only:
        out = joined.filter("v > u").select("grp", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("grp", F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("grp", "u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("grp", "u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h)).first())


def component_stats(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per group: largest component, its share of the group's nodes, number of components.

    ``sizes`` has ``grp, n_nodes`` and decides which groups appear; no edges gives zeros.
    """
    comp = components(edges).groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    per = comp.groupBy("grp").agg(F.max("n").alias("max_size"), F.count(F.lit(1)).alias("n_components"))
    return sizes.join(per, "grp", "left").select(
        "grp", F.coalesce("max_size", F.lit(0)).alias("max_size"),
        (F.coalesce("max_size", F.lit(0)) / F.greatest("n_nodes", F.lit(1))).alias("max_frac"),
        F.coalesce("n_components", F.lit(0)).alias("n_components"))
