"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage_counted, unstage

ROWS_PER_TASK = 200_000
HELD_ROWS = 1_000_000  # edges that a task holds at once


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not the smallest of their component among these edges."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as a forest of stars, u > v; of every ``HELD_ROWS`` edges."""
    text = edges.schema["u"].dataType.simpleString() == "string"

    def column(c: pa.Array) -> np.ndarray:
        return c.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(c) for c in zip(*held, strict=True)))

        for b in batches:
            held.append((column(b["u"]), column(b["v"])))
            if sum(len(x) for x, _ in held) > HELD_ROWS:
                held = [stars()]
                if len(held[0][0]) > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if text else None) for x in held[0]], names=["u", "v"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if text else None) for x in stars()], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Edges are first contracted to stars where they lie, so that a group of many edges
    leaves few. Each round deals the edges by their larger end and contracts them again (a
    node's smaller neighbours get linked to the smallest of them), then lets every edge
    jump from its smaller end to that end's own smallest neighbour. Only ends that do have
    one are joined: their table (``moves``) is staged, so that a centre that holds many
    edges is broadcast while small, and split as a skewed partition beyond. The number of
    rounds grows with the logarithm of the longest path. Null ends and loops give no edge,
    repeated edges count once.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    alone = e.where("u = v").select(F.col("u").alias("node"))
    e, n = stage_counted(_contracted(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "cc")
    for _ in range(max_rounds):
        if not n:
            break
        old = e
        e, n = stage_counted(_contracted(e.repartition(max(1, -(-n // ROWS_PER_TASK)), "u")), "cc")
        unstage(old)
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        low, nodes = stage_counted(low, "cc")
        moves, moved = stage_counted(e.select("v").distinct().join(low.select(F.col("u").alias("v"), "m"), "v"), "cc")
        unstage(low)
        if nodes == n and not moved:
            unstage(moves)
            break
        old = e
        e, n = stage_counted(e.join(moves, "v", "left").select("u", F.coalesce("m", "v").alias("v")), "cc")
        unstage(old)
        unstage(moves)
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    rest = alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(rest)
