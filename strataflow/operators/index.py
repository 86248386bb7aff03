"""Cell-partitioned vector search: a coarse quantiser fitted on a bounded sample, every row assigned, few cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import kept
from .search import QUERY_BLOCK_BYTES, _unit, best_rows, vector_rows


def fit_cells(vectors: DataFrame, n_cells: int, sample_rows: int = 20_000, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Centroids of spherical k-means on at most about sample_rows rows, drawn by a hash of the vector."""
    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").collect()
    x = _unit(np.array(sorted(r["embedding"] for r in rows), dtype=np.float64).reshape(len(rows), -1))
    n_cells = min(n_cells, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n_cells]]
    for _ in range(rounds if n_cells else 0):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.bincount(own, minlength=n_cells)[:, None] > 0, _unit(sums), centres)
    return centres


def assign_cells(vectors: DataFrame, key: list[str], centres: np.ndarray, probes: int = 1) -> DataFrame:
    """key, ``embedding`` (at unit length), ``cell``: a row for each of the nearest probes cells."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if not batch.num_rows or not len(c):
                continue
            m = _unit(vector_rows(batch.column(len(key)), c.shape[1]))
            near = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(m)), near.shape[1])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * m.shape[1], pa.int32()), pa.array(m[at].ravel()))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in batch.columns[: len(key)]), values, pa.array(near.ravel().astype(np.int32))], names=[*key, "embedding", "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*key).schema)
    return vectors.select(*key, "embedding").mapInArrow(run, f"{schema}, embedding array<double>, cell int")


def search_cells(index: DataFrame, key: list[str], probed: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """by (``query_id``), key, ``rank, score``: the k rows with the highest cosine of those in the cells that a query probes.

    probed: by, ``embedding, cell``. Queries are broadcast in blocks of bounded size, each task takes a matrix product of a cell's rows with
    the queries that probe it, and keeps its own k best; rows of other cells aren't read where the index is sorted by cell.
    """
    by = by or ["query_id"]
    queries = kept(probed.groupBy(*by).agg(F.first("embedding").alias("embedding"), F.collect_set("cell").alias("cells")))
    n, dim = queries.count(), len((queries.select("embedding").first() or [[]])[0])
    blocks = max(1, -(-8 * n * dim // QUERY_BLOCK_BYTES))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*queries.select(*by).schema, *index.select(*key).schema])
    found = None
    for block in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == block)).toPandas()
        part = _searched(index, key, own, k, by, schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, *key, "rank", "score")


def _searched(index: DataFrame, key: list[str], queries, k: int, by: list[str], schema: str) -> DataFrame:
    ids, q = [queries[c].to_numpy() for c in by], np.array(queries["embedding"].tolist(), dtype=np.float64).reshape(len(queries), -1)
    probing: dict[int, list[int]] = {}
    for i, cells in enumerate(queries["cells"]):
        for c in cells:
            probing.setdefault(int(c), []).append(i)
    held = index.sparkSession.sparkContext.broadcast((ids, q, {c: np.array(x) for c, x in probing.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, probing = held.value

        def parts():
            for batch in batches:
                cells = batch.column(len(key)).to_numpy()
                for c in np.unique(cells).tolist():
                    if c not in probing:
                        continue
                    own = np.flatnonzero(cells == c)
                    m = vector_rows(batch.column(len(key) + 1).take(pa.array(own)), q.shape[1])
                    score = np.full((len(q), len(own)), -np.inf)
                    score[probing[c]] = np.round(q[probing[c]] @ m.T, 9)
                    yield [x.take(pa.array(own)) for x in batch.columns[: len(key)]], {"score": score}, score > -np.inf

        for rows in best_rows(parts(), key, k, len(q)):
            at = rows.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in ids), *rows.columns[1:]], names=[*by, *key, "score"])

    cells = index if len(probing) > 1000 else index.where(F.col("cell").isin(*probing))
    return cells.select(*key, "cell", "embedding").mapInArrow(run, f"{schema}, score double")
