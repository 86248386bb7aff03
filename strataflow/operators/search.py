"""Vector search, fusion and reranking for batches of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block of queries is broadcast; its vectors take at most this many bytes.
QUERY_BLOCK_BYTES = 8 << 20


#: Rows whose words are hashed at once have about so many, where a row counts for at least ROW_WORDS.
HASHED_WORDS, ROW_WORDS = 1 << 19, 64


def lengths_of(words: pa.Array) -> np.ndarray:
    """How many words the rows of an array column have; a null row has none."""
    return np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def places_of(words: pa.Array) -> np.ndarray:
    """The row of each word of an array column of words, in order."""
    return np.repeat(np.arange(len(words)), lengths_of(words))


def word_slices(words: pa.Array, most: int = HASHED_WORDS) -> Iterator[pa.Array]:
    """The rows in order, in slices of about so many words; a row is not cut."""
    part = np.cumsum(np.maximum(lengths_of(words), ROW_WORDS)) // most
    for start, end in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]):
        yield words.slice(start, end - start)


def hashed_rows(words: pa.Array, dim: int) -> np.ndarray:
    """The embeddings of some rows of words; a word is hashed once, however often it comes."""
    coded = words.flatten().dictionary_encode()
    heads = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:4] for t in coded.dictionary.to_numpy(zero_copy_only=False))
    buckets = np.frombuffer(heads, ">u4").astype(np.int64) % dim
    counts = np.bincount(places_of(words) * dim + buckets[coded.indices.to_numpy()], minlength=len(words) * dim).reshape(len(words), dim)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norm, out=np.zeros(counts.shape), where=norm > 0)


def hash_embeddings(rows: DataFrame, key: list[str], tokens: str, dim: int = 64) -> DataFrame:
    """key, ``embedding``: token counts by hash bucket, at unit length (zeros without tokens). tokens: an array column, the only one that goes to Python."""

    @F.arrow_udf("array<double>")
    def embedded(words: pa.Array) -> pa.Array:
        vectors = [hashed_rows(part, dim).ravel() for part in word_slices(words)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(np.concatenate(vectors)))

    return rows.select(*key, embedded(F.col(tokens)).alias("embedding"))


def vector_rows(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """An array column as rows of numbers, without a Python object for each; a null row is one of zeros. dim: their length, if no row may tell."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    dim = int(sizes.max(initial=0)) if dim is None else dim
    out = np.zeros((len(column), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat):
        out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_top_k(vectors: DataFrame, key: list[str], queries: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """by (``query_id``), key, ``rank, score``: the k rows with the highest cosine for each query, ties in order of the key.

    vectors: key and ``embedding``; queries: by and ``embedding``. Queries go through in blocks of bounded size: each task takes one
    matrix product per batch and keeps its own k best, so that k rows for each query and task meet in the final ranking.
    """
    by = by or ["query_id"]
    n, dim = queries.count(), len((queries.select("embedding").first() or [[]])[0])
    per_block = max(1, QUERY_BLOCK_BYTES // (8 * max(1, dim)))
    found = None
    for block in range(-(-n // per_block) or 1):
        own = queries if n <= per_block else queries.where(F.pmod(F.xxhash64(*by), F.lit(-(-n // per_block))) == block)
        part = _block_top_k(vectors, key, own.select(*by, "embedding"), k, by)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, *key, "rank", "score")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=m.copy(), where=n > 0)


def best_rows(parts: Iterator[tuple[list[pa.Array], dict[str, np.ndarray], np.ndarray | None]], key: list[str], k: int, n_queries: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query over all parts of a task: ``q`` (the query's place), key and the values.

    A part has the key columns of its rows, values (query x row), the first of which is the score, and which rows count for which query.
    Ties are in order of the further values, then of the key. What is held stays within a few times k rows for each query.
    """
    held, size, least, order = [], 0, np.full(n_queries, -np.inf), []

    def pruned() -> pa.Table:
        rows = pa.concat_tables(held).sort_by(order)
        q = rows.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        rows, q, score = rows.filter(pa.array(place < k)), q[place == k - 1], rows.column(order[1][0]).to_numpy()[place == k - 1]
        least[q] = score
        return rows

    for columns, values, counts in parts:
        score = next(iter(values.values()))
        order = [("q", "ascending"), *((n, "descending") for n in values), *((c, "ascending") for c in key)]
        ok = score >= least[:, None] if counts is None else counts & (score >= least[:, None])
        if score.shape[1] > k:
            # Of the part's own rows, too, only those that reach its k-th best can be among the best.
            last = score.shape[1] - k
            ok &= score >= np.partition(np.where(ok, score, -np.inf), last, axis=1)[:, last][:, None]
        q, r = np.nonzero(ok)
        take = pa.array(r)
        held.append(pa.table([pa.array(q), *(c.take(take) for c in columns), *(pa.array(v[q, r]) for v in values.values())], names=["q", *key, *values]))
        size += len(q)
        if size > 4 * k * n_queries + 50_000:
            held[:] = [pruned()]
            size = held[0].num_rows
    if held:
        yield from pruned().combine_chunks().to_batches(max_chunksize=10_000)


def _schema(*columns) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)


def _block_top_k(vectors: DataFrame, key: list[str], block: DataFrame, k: int, by: list[str]) -> DataFrame:
    queries = block.toPandas()  # bounded by QUERY_BLOCK_BYTES
    ids = [queries[c].to_numpy() for c in by]
    q = _unit(np.array(queries["embedding"].tolist(), dtype=np.float64)) if len(queries) else np.zeros((0, 1))
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))
    schema = _schema(*block.select(*by).schema, *vectors.select(*key).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value

        def parts():
            for batch in batches:
                step = max(16, min(2048, (1 << 19) // max(1, len(q))))
                for at in range(0, batch.num_rows if len(q) else 0, step):
                    part = batch.slice(at, step)
                    m = _unit(vector_rows(part.column(len(key)), q.shape[1]))
                    yield part.columns[: len(key)], {"score": np.round(q @ m.T, 9)}, None

        for rows in best_rows(parts(), key, k, len(q)):
            at = rows.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in ids), *rows.columns[1:]], names=[*by, *key, "score"])

    return vectors.select(*key, "embedding").mapInArrow(run, f"{schema}, score double")


def more_like(vectors: DataFrame, key: str, chosen: DataFrame, k: int) -> DataFrame:
    """``query_id``, key, ``rank, score``: the k rows most like each chosen one, itself left out. Keys that aren't in the table have no rows."""
    queries = vectors.join(chosen.select(key).distinct(), key).select(F.col(key).alias("query_id"), "embedding")
    top = exact_top_k(vectors, [key], queries, k + 1).where(F.col(key) != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


def best_dot(vectors: DataFrame, key: list[str], queries: DataFrame, group: str) -> DataFrame:
    """key, ``best``: for each row the greatest dot product with a query of its group; rows whose group has none are left out.

    queries: group and ``embedding``; they are broadcast in blocks of bounded size, so a group may have any share of the rows.
    """
    n, dim = queries.count(), len((queries.select("embedding").first() or [[]])[0])
    blocks, found = max(1, -(-8 * n * dim // QUERY_BLOCK_BYTES)), None
    for block in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("embedding"), F.lit(blocks)) == block)).toPandas()
        by_group = {g: np.array(rows["embedding"].tolist(), dtype=np.float64) for g, rows in own.groupby(group)}
        held = vectors.sparkSession.sparkContext.broadcast(by_group)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, whole = np.full(batch.num_rows, -np.inf), batch.column(len(key)).dictionary_encode()
                places = whole.indices.to_numpy(zero_copy_only=False)
                for i, g in enumerate(whole.dictionary.to_pylist()):
                    if g in held.value:
                        rows = np.flatnonzero(places == i)
                        m = vector_rows(batch.column(len(key) + 1).take(pa.array(rows)), held.value[g].shape[1])
                        best[rows] = (m @ held.value[g].T).max(axis=1)
                keep = pa.array(np.flatnonzero(best > -np.inf))
                yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns[: len(key)]), pa.array(best).take(keep)], names=[*key, "best"])

        part = vectors.select(*key, F.col(group).alias("_group"), "embedding").mapInArrow(run, f"{_schema(*vectors.select(*key).schema)}, best double")
        found = part if found is None else found.unionByName(part)
    return found if blocks == 1 else found.groupBy(*key).agg(F.max("best").alias("best"))


def fuse(hits: DataFrame, key: list[str], k0: int = 60) -> DataFrame:
    """Reciprocal rank fusion over ``query_id, sub_idx``, key, ``rank`` (from 1), ``score``.

    ``rrf``, the score of the first list that has the row as ``vec_score``, and where it was first seen.
    """
    first = F.struct("sub_idx", "rank")
    return hits.groupBy("query_id", *key).agg(F.sum(1 / (k0 + F.col("rank"))).alias("rrf"), F.min_by("score", first).alias("vec_score"), F.min(first).alias("seen"))


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """A column scaled to 0..1 within its query; all 0 where the range is nothing."""
    w = W.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn(out, F.when(high - low > 1e-6, (F.col(column) - low) / (high - low)).otherwise(0.0))


def rerank(fused: DataFrame, kw: DataFrame, key: list[str], vec_weight: float, kw_weight: float, threshold: float, top_k: int | None) -> DataFrame:
    """``query_id``, key, ``rank, score, vec_score, kw_score``; kw: ``query_id``, key, ``kw``. The threshold comes before the limit."""
    rows = fused.join(kw, ["query_id", *key], "left").withColumn("raw", F.greatest(F.lit(0.0), F.coalesce("kw", F.lit(0.0))))
    rows = min_max(rows, "raw", "kw_score").withColumn("score", F.round(F.col("vec_score") * vec_weight + F.col("kw_score") * kw_weight, 9))
    rows = rows.where(F.col("score") >= threshold)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.round("rrf", 12)), "seen", *key))
    rows = rows.withColumn("rank", rank)
    return (rows if top_k is None else rows.where(F.col("rank") <= top_k)).select("query_id", *key, "rank", "score", "vec_score", "kw_score")


def by_fusion(fused: DataFrame, key: list[str]) -> DataFrame:
    """All fused rows in order of their fused score."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "seen", *key))
    return fused.select("query_id", *key, rank.alias("rank"), F.col("rrf").alias("score"), "vec_score", F.lit(None).cast("double").alias("kw_score"))


def by_vector(fused: DataFrame, key: list[str], threshold: float, top_k: int | None, parity: bool = False, order: str | None = None) -> DataFrame:
    """Rows by their vector score alone; with parity the threshold is held against the fused score, which is the order, too, unless one is given."""
    rows = fused.where(F.col("rrf" if parity else "vec_score") >= threshold)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(order or ("rrf" if parity else "vec_score")), F.desc(F.round("rrf", 12)), "seen", *key))
    rows = rows.withColumn("rank", rank)
    rows = rows if top_k is None else rows.where(F.col("rank") <= top_k)
    return rows.select("query_id", *key, "rank", F.col("rrf" if parity else "vec_score").alias("score"), "vec_score", F.lit(None).cast("double").alias("kw_score"))


def search_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.count("*").alias("total"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg("score").alias("avg_score"))
