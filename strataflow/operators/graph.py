"""Layered neighbour graphs: vectors in graphs of bounded size, built and searched inside tasks, whose results are merged.

A node is on layer l and those below with a probability that falls by M with each layer, by a hash of its key. On each layer a node is
linked to at most M others (twice as many on the lowest): of its ef_con nearest ones those that are nearer to it than to any chosen
before, then the nearest of the rest, and those that chose it. A search looks at the whole top layer, then goes down with a beam of the ef
best nodes, which starts from the best of the layer above. All queries of a block go at once: a step is a product of each query with its best unseen node's neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import QUERY_BLOCK_BYTES, _unit, vector_rows

#: Nodes of a graph, and queries that a task takes at once: what it holds for a pair of them is a byte.
GRAPH_ROWS, QUERIES_AT_ONCE = 4096, 512


def _nearest(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row, the greatest first."""
    k = min(k, score.shape[1])
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable"), axis=1)


def linked(vectors: np.ndarray, m: int, most: int, ef_con: int) -> np.ndarray:
    """The neighbours of each of some unit vectors, at most so many, -1 where there are fewer."""
    n = len(vectors)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int32)
    score = (vectors @ vectors.T).astype(np.float32)
    np.fill_diagonal(score, -np.inf)
    near = _nearest(score, min(ef_con, n - 1))
    chosen, count, rows = np.full((n, min(m, n - 1)), -1, dtype=np.int32), np.zeros(n, dtype=np.int64), np.arange(n)
    skipped = np.zeros(near.shape, dtype=bool)
    for r in range(near.shape[1]):
        c = near[:, r]
        others = np.where(chosen >= 0, score[c[:, None], np.maximum(chosen, 0)], -np.inf)
        good = (count < chosen.shape[1]) & (others.max(axis=1) < score[rows, c])
        chosen[rows[good], count[good]] = c[good]
        count += good
        skipped[:, r] = ~good
    for r in range(near.shape[1]):
        good = skipped[:, r] & (count < chosen.shape[1])
        chosen[rows[good], count[good]] = near[good, r]
        count += good
    # Links go both ways; where too many come, those that a node chose stay, then the nearest.
    a, b = np.repeat(rows, count), chosen[chosen >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    come = ~np.isin(pairs, a * n + b)
    a, b = pairs // n, pairs % n
    order = np.lexsort((-score[a, b], come, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, min(most, int(place.max()) + 1)), -1, dtype=np.int32)
    keep = place < most
    out[a[keep], place[keep]] = b[keep]
    return out


def layers_of(vectors: np.ndarray, draws: np.ndarray, m: int, ef_con: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, neighbours) of each layer from the lowest. draws: numbers in (0, 1], evenly spread."""
    top = np.floor(-np.log(draws) / np.log(max(2, m))).astype(int)
    out, layer = [], 0
    while layer == 0 or (top >= layer).any():
        nodes = np.flatnonzero(top >= layer)
        inside = linked(vectors[nodes], m, 2 * m if layer == 0 else m, ef_con)
        out.append((nodes.astype(np.int32), np.where(inside >= 0, nodes[np.maximum(inside, 0)], -1).astype(np.int32)))
        layer += 1
    return out


def beam(vectors: np.ndarray, neighbours: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, nodes, seen): the ef best nodes that are met for each query, -inf where there are fewer. start: nodes to begin from, -1 for none; neighbours by node."""
    n, rows = len(vectors), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), dtype=bool)
    seen[:, n] = True
    nodes, scores, done = np.full((len(q), ef), n), np.full((len(q), ef), -np.inf), np.ones((len(q), ef), dtype=bool)

    def met(new: np.ndarray) -> None:
        nonlocal nodes, scores, done
        new = np.where(new < 0, n, new)
        new = np.where(seen[rows, new], n, new)
        seen[rows, new] = True
        score = np.where(new < n, np.einsum("qd,qkd->qk", q, vectors[np.minimum(new, n - 1)]), -np.inf)
        all_scores = np.concatenate([scores, score], axis=1)
        best = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        scores = np.take_along_axis(all_scores, best, axis=1)
        nodes = np.take_along_axis(np.concatenate([nodes, new], axis=1), best, axis=1)
        done = np.take_along_axis(np.concatenate([done, new == n], axis=1), best, axis=1)

    met(start)
    while True:
        waiting = np.where(done, -np.inf, scores)
        at = waiting.argmax(axis=1)
        active = waiting[rows[:, 0], at] > -np.inf
        if not active.any():
            return scores, nodes, seen[:, :n]
        own = nodes[rows[:, 0], at]
        done[rows[:, 0], at] = True
        met(np.where(active[:, None], neighbours[np.where(active, own, 0)], -1))


def searched(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, nodes, how many products were taken): the k best of those that the beam meets, -inf where there are fewer."""
    ef = min(max(ef, k), len(vectors))
    nodes, taken = layers[-1][0], 0
    start = nodes[_nearest(q @ vectors[nodes].T, min(ef, len(nodes)))] if len(layers) > 1 else nodes[None, :1].repeat(len(q), axis=0)
    taken += len(q) * (len(nodes) if len(layers) > 1 else 0)
    for level in range(len(layers) - 2 if len(layers) > 1 else 0, -1, -1):
        own, links = layers[level]
        neighbours = np.full((len(vectors), links.shape[1]), -1, dtype=np.int32)
        neighbours[own] = links
        scores, found, seen = beam(vectors, neighbours, q, start, ef)
        taken += int(seen.sum())
        start = np.where(scores > -np.inf, found, -1)
    order = np.lexsort((found, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1), taken


_LAYER = pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary())])


def graphs(vectors: DataFrame, key: list[str], m: int, ef_con: int) -> DataFrame:
    """A row for each graph: an array of each key column, ``vectors`` (64-bit numbers of unit length), ``dim`` and ``layers``. vectors: key and ``embedding``; rows without one are left out."""
    kinds = [vectors.schema[c].dataType for c in key]
    ddl = ", ".join(f"`{c}` array<{k.simpleString()}>" for c, k in zip(key, kinds, strict=True)) + ", vectors binary, dim int, layers array<struct<nodes: binary, neighbours: binary>>"

    def packed(keys: list[pa.Array], own: np.ndarray) -> pa.RecordBatch:
        unit = _unit(own)
        names = zip(*(c.to_pylist() for c in keys), strict=True)
        draws = np.array([(int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=6).digest()) + 1) / (1 << 48) for x in names])
        layers = [{"nodes": a.tobytes(), "neighbours": b.tobytes()} for a, b in layers_of(unit, draws, m, ef_con)]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(unit)], pa.int32()), c) for c in keys]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([unit.tobytes()]), pa.array([unit.shape[1]], pa.int32()), pa.array([layers], pa.list_(_LAYER))], names=[*key, "vectors", "dim", "layers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, GRAPH_ROWS - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == GRAPH_ROWS:
                    yield from whole(held)
                    held, size = [], 0
        if size:
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        yield packed([table.column(i).chunk(0) for i in range(len(key))], vector_rows(table.column(len(key)).chunk(0)))

    return vectors.where(F.col("embedding").isNotNull()).select(*key, "embedding").mapInArrow(run, ddl)


def search_graphs(graphs: DataFrame, key: list[str], queries: DataFrame, k: int, ef: int, by: list[str] | None = None) -> DataFrame:
    """by (``query_id``), key, ``rank, score``: the k best of what each graph's beam meets, ties in order of the key. queries: by and ``embedding``; they are broadcast in blocks of bounded size."""
    by = by or ["query_id"]
    n, dim = queries.count(), len((queries.select("embedding").first() or [[]])[0])
    blocks, found = max(1, -(-8 * n * dim // QUERY_BLOCK_BYTES)), None
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*by).schema), *(f"`{c}` {graphs.schema[c].dataType.elementType.simpleString()}" for c in key), "score double"])
    for block in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == block)).toPandas()
        q = _unit(np.array(own["embedding"].tolist(), dtype=np.float64)) if len(own) else np.zeros((0, 1))
        held = graphs.sparkSession.sparkContext.broadcast(([own[c].to_numpy() for c in by], q))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for batch in batches:
                for at in range(batch.num_rows):
                    keys = [batch.column(i).slice(at, 1).flatten() for i in range(len(key))]
                    dim = batch.column(len(key) + 1)[at].as_py()
                    vectors = np.frombuffer(batch.column(len(key))[at].as_py(), dtype=np.float64).reshape(-1, dim)
                    layers = []
                    for x in batch.column(len(key) + 2)[at].as_py():
                        nodes = np.frombuffer(x["nodes"], dtype=np.int32)
                        layers.append((nodes, np.frombuffer(x["neighbours"], dtype=np.int32).reshape(len(nodes), -1)))
                    for first in range(0, len(q), QUERIES_AT_ONCE):
                        scores, nodes, _ = searched(vectors, layers, q[first : first + QUERIES_AT_ONCE], k, ef)
                        r, c = np.nonzero(scores > -np.inf)
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[first + r]) for x in ids), *(x.take(pa.array(nodes[r, c])) for x in keys), pa.array(np.round(scores[r, c], 9))], names=[*by, *key, "score"])

        part = graphs.select(*key, "vectors", "dim", "layers").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, *key, "rank", "score")
