"""Connected components of an edge table, contracted in parts and connected by alternating large and small stars.

The edges are dealt into parts of a bounded size, each of which a task replaces by stars around the least nodes that it connects; edges that are one
part are settled by that. Otherwise rounds of stars connect the parts: each is two grouped minima (combined before the shuffle) and two joins, in
which the nodes of many edges are broadcast, so that a star's edges never meet in one task, and begins by contracting the edges that are left.
A round's edges are written to the shared folder, so that none depends on an executor that may go. The number of edges never grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_dealt, written

#: Edges that one task contracts, in some 50 MB.
PART_EDGES = 1 << 18


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, beside: DataFrame, n: int) -> DataFrame:
    """edges (``u, v``) with m: the least neighbour that u has in beside, whose n rows hold all of edges."""
    least = written(beside.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")))
    return join_dealt(edges, least, "u", n, stored=True).select("u", "v", "m")


def least_connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and for each the least node that they connect it with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent, (a, b) = np.arange(len(nodes)), ends.reshape(2, -1)
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[parent]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges that connect what these do: stars of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own_batches := list(batches):
            table = pa.Table.from_batches(own_batches)
            nodes, least = least_connected(*(c.to_numpy() for c in table.columns))
            own = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], names=["u", "v"])

    return edges.repartition(parts).mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 50, part_edges: int = PART_EDGES) -> DataFrame:
    """``node, root``: for each node of an edge (``a, b``), the smallest node that it is connected with.

    Nodes without an edge to another node have no row. Repeated edges and edges in both directions don't matter. What isn't settled after max_rounds is an error.
    """
    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        parts = -(-state[0] // part_edges)
        e = written(_contracted(e, parts).distinct() if parts > 1 else _contracted(e, 1))
        if parts == 1:
            break
        n = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both.where(F.col("v") > F.col("u")), both, 2 * n).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        joined = _with_least(large, large, large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(joined.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        e, (old, state) = new, (state, _state(new))
        if state == old:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
