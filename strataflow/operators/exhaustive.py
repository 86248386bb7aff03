"""Keyword and combined scores of every row for a stated query set, without pairs or postings in a shuffle.

The queries go through in blocks whose matrices have a bounded size. A task scores its rows against a block by a matrix product and the
postings of the block's own terms, and hands on its own k best, so that k rows for each query and task meet in the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keyword import B, K1
from .search import _unit, best_rows, places_of, vector_rows

#: The matrices of a block, which is broadcast, take about so many bytes each.
BLOCK_BYTES = 32 << 20
#: Rows that are scored at once.
SLICE = 256
#: A term that more queries of a block ask is a column of a matrix; the others have postings.
DENSE = 8


@dataclass(frozen=True)
class Block:
    """Queries by row: unit vectors, and weights (how often a term is asked, times its idf) by term, in the order of terms.

    Few queries ask most terms. sizes, starts: how many postings a term has and where they begin in askers (queries) and weights. The
    terms that many ask have none, but a column of matrix, by places (else -1).
    """

    ids: pa.Array
    vectors: np.ndarray
    terms: pa.Array
    sizes: np.ndarray
    starts: np.ndarray
    askers: np.ndarray
    weights: np.ndarray
    places: np.ndarray
    matrix: np.ndarray
    low: np.ndarray | None = None
    span: np.ndarray | None = None


def query_blocks(queries: DataFrame, weights: DataFrame) -> Iterator[Block]:
    """queries: ``query_id, embedding`` (null where only keywords count); weights: ``query_id, term, weight``."""
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    dim, terms = max(dim, 0), weights.count()
    count = max(1, math.ceil(math.sqrt(8 * n * terms / BLOCK_BYTES)), math.ceil(8 * n * dim / BLOCK_BYTES))
    for i in range(count):
        own = F.pmod(F.xxhash64("query_id"), F.lit(count)) == i
        q = queries.where(own).select("query_id", "embedding").toArrow()
        w = weights.where(own).select("query_id", "term", "weight").collect()
        if not q.num_rows:
            continue
        names, embeddings = (c.combine_chunks() for c in q.columns)
        ids = {name: j for j, name in enumerate(names.to_pylist())}
        columns = {t: j for j, t in enumerate(sorted({r["term"] for r in w}))}
        asked = {(columns[r["term"]], ids[r["query_id"]]): r["weight"] for r in w if r["query_id"] in ids and r["weight"]}
        cells = np.array(sorted(asked), dtype=np.int64).reshape(-1, 2)
        by, weight = cells[:, 0], np.array([asked[x, y] for x, y in cells.tolist()], dtype=np.float64)
        sizes = np.bincount(by, minlength=len(columns))
        many = np.flatnonzero(sizes > DENSE)
        places = np.full(len(columns), -1)
        places[many] = np.arange(len(many))
        matrix, dense = np.zeros((len(names), len(many))), places[by] >= 0
        matrix[cells[dense, 1], places[by[dense]]] = weight[dense]
        sizes[many] = 0
        yield Block(names, _unit(vector_rows(embeddings, dim)), pa.array(list(columns), pa.string()), sizes, np.cumsum(sizes) - sizes, cells[~dense, 1], weight[~dense], places, matrix)


def _keyword_scores(block: Block, words: pa.Array, avgdl: float, matches: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """BM25 by query and row and, with matches, whether they share a term that has a weight."""
    n, shape = len(words), (len(block.ids), len(words))
    at = places_of(words)
    columns = pc.index_in(words.flatten(), value_set=block.terms).fill_null(-1).to_numpy()
    asked = columns >= 0
    pairs, tf = np.unique(at[asked] * len(block.terms) + columns[asked], return_counts=True)
    row, term = np.divmod(pairs, max(1, len(block.terms)))
    dl = np.bincount(at, minlength=n)
    saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / (avgdl or 1.0)))
    # Each term of a row meets its own postings, so that the work is that of the queries that ask it.
    sizes = block.sizes[term]
    met = np.arange(sizes.sum()) + np.repeat(block.starts[term] - (np.cumsum(sizes) - sizes), sizes)
    cells = block.askers[met] * n + np.repeat(row, sizes)
    dense = np.zeros((block.matrix.shape[1], n))
    often = block.places[term] >= 0
    dense[block.places[term[often]], row[often]] = saturated[often]
    scores = np.bincount(cells, block.weights[met] * np.repeat(saturated, sizes), minlength=shape[0] * n).reshape(shape) + block.matrix @ dense
    if not matches:
        return scores, None
    shared = (block.matrix != 0).astype(np.float32) @ (dense > 0).astype(np.float32) > 0
    return scores, shared | (np.bincount(cells, minlength=shape[0] * n) > 0).reshape(shape)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _fields(rows: DataFrame, key: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)


def _union(parts: list[DataFrame], rows: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keyword_top_k(rows: DataFrame, key: list[str], queries: DataFrame, weights: DataFrame, avgdl: float, k: int) -> DataFrame:
    """``query_id``, key, ``rank, kw``: the k rows with the highest BM25 of those that share a term, ties in order of the key.

    rows: key and ``words``; scores are rounded to 6 digits. Null or empty words match nothing.
    """
    schema = f"{_fields(queries, ['query_id'])}, {_fields(rows, key)}, kw double"

    def scored(block: Block) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = held.value

            def parts():
                for part in _slices(batches):
                    raw, shared = _keyword_scores(b, part.column(len(key)), avgdl, matches=True)
                    yield part.columns[: len(key)], {"kw": np.round(raw, 6)}, shared

            for best in best_rows(parts(), key, k, len(b.ids)):
                yield pa.RecordBatch.from_arrays([b.ids.take(best.column(0)), *best.columns[1:]], names=["query_id", *key, "kw"])

        return rows.select(*key, "words").mapInArrow(run, schema)

    found = _union([scored(b) for b in query_blocks(queries, weights)], rows, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("kw"), *key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", *key, "rank", "kw")


def hybrid_top_k(rows: DataFrame, key: list[str], queries: DataFrame, weights: DataFrame, avgdl: float, vec_weight: float, kw_weight: float, threshold: float, k: int, metric: str = "cosine") -> DataFrame:
    """``query_id``, key, ``rank, score, vec_score, kw_score``: the k best of all rows at or above the threshold.

    rows: key, ``words, embedding``. Keyword scores are scaled to 0..1 over all rows of a query: a first pass finds their range.
    """
    sc, chosen = rows.sparkSession.sparkContext, rows.select(*key, "words", "embedding")
    schema = f"{_fields(queries, ['query_id'])}, {_fields(rows, key)}, score double, vec_score double, kw_score double"

    def ranged(block: Block) -> Block:
        held = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, low, high = held.value, None, None
            for part in _slices(batches):
                raw = np.maximum(_keyword_scores(b, part.column(0), avgdl)[0], 0.0)
                low = raw.min(axis=1) if low is None else np.minimum(low, raw.min(axis=1))
                high = raw.max(axis=1) if high is None else np.maximum(high, raw.max(axis=1))
            if low is not None:
                yield pa.RecordBatch.from_arrays([b.ids, pa.array(low), pa.array(high)], names=["query_id", "low", "high"])

        found = rows.select("words").mapInArrow(run, f"{_fields(queries, ['query_id'])}, low double, high double").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        ranges = {r["query_id"]: (r["low"], r["high"] - r["low"]) for r in found.collect()}  # a row for each query of the block
        low, span = np.array([ranges.get(i, (0.0, 0.0)) for i in block.ids.to_pylist()]).reshape(-1, 2).T
        return replace(block, low=low, span=span)

    def scored(block: Block) -> DataFrame:
        held = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = held.value
            flat = np.where(b.span > 1e-6, b.span, np.inf)[:, None]

            def parts():
                for part in _slices(batches):
                    raw = np.maximum(_keyword_scores(b, part.column(len(key)), avgdl)[0], 0.0)
                    kw = (raw - b.low[:, None]) / flat
                    m = vector_rows(part.column(len(key) + 1), b.vectors.shape[1])
                    vec = b.vectors @ _unit(m).T
                    if metric == "l2":
                        vec = 1 / (1 + np.sqrt(np.maximum(0.0, 2 - 2 * vec)) + 1e-6)
                    vec = np.round(vec, 9)
                    score = np.round(vec * vec_weight + kw * kw_weight, 9)
                    yield part.columns[: len(key)], {"score": score, "vec_score": vec, "kw_score": kw}, score >= threshold

            for best in best_rows(parts(), key, k, len(b.ids)):
                yield pa.RecordBatch.from_arrays([b.ids.take(best.column(0)), *best.columns[1:]], names=["query_id", *key, "score", "vec_score", "kw_score"])

        return chosen.mapInArrow(run, schema)

    found = _union([scored(ranged(b)) for b in query_blocks(queries, weights)], rows, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vec_score"), *key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", *key, "rank", "score", "vec_score", "kw_score")
