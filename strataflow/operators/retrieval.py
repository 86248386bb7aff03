"""Batches of queries against an index: sub-queries, candidates by vector, fusion, keyword scores, reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cache_key, tokens
from ..functions.vectors import l2_score
from ..plans.config import Config
from ..sources.stored import kept
from . import exhaustive, graph, keyword, search
from .index import assign_cells, search_cells
from .segmentation import Tokenizer


@dataclass(frozen=True)
class Index:
    """chunks: key, ``words, embedding`` and further columns; term_stats: ``term, df, idf``, null where there are no keywords.

    avgdl: the mean number of words of the chunks that have some. cells: key, ``embedding, cell`` and further columns, with the cells' centres,
    and graphs: the neighbour graphs of ``operators.graph``, where an index has them.
    """

    key: list[str]
    chunks: DataFrame
    term_stats: DataFrame | None = None
    avgdl: float = 0.0
    cells: DataFrame | None = None
    centres: np.ndarray | None = None
    graphs: DataFrame | None = None

    def where(self, condition: Column | None) -> Index:
        """The rows that a search may find; the statistics stay those of all."""
        if condition is None:
            return self
        return replace(self, chunks=self.chunks.where(condition), cells=None if self.cells is None else self.cells.where(condition), graphs=None)


@dataclass(frozen=True)
class Facts:
    """Numbers of chunks, of those with words and of words: of several sets of chunks they add up."""

    n: int
    worded: int
    words: int

    def plus(self, other: Facts, sign: int = 1) -> Facts:
        return Facts(self.n + sign * other.n, self.worded + sign * other.worded, self.words + sign * other.words)

    @property
    def avgdl(self) -> float:
        return self.words / self.worded if self.worded else 0.0


#: Rows with key columns and a column of words to the same key with ``embedding array<double>``: (rows, key, words, dimension).
Embedder = Callable[[DataFrame, list[str], str, int], DataFrame]


def index_of(chunks: DataFrame, key: list[str], dim: int, text: str = "content", embed: Embedder = search.hash_embeddings, tokenize: Tokenizer = tokens, with_text: bool = True, with_keywords: bool = True) -> Index:
    """An index of the chunks, with their other columns, each table computed once. tokenize: what words are, for keywords and for the embedding.

    Without with_text the text isn't kept, as a search doesn't read it; without with_keywords there are neither words nor statistics, and
    a search goes by vectors alone. Statistics are summed up from counts that are made beside the embeddings.
    """
    rows = with_words(chunks, text, tokenize, with_text)
    if not with_keywords:
        return Index(key, kept(embed(rows, [c for c in rows.columns if c != "words"], "words", dim)))
    rows = rows.withColumns({"_size": F.size("words"), "_df": keyword.partial_frequencies("words")})
    embedded = kept(embed(rows, rows.columns, "words", dim))
    facts = facts_of(embedded, F.col("_size"))
    stats = kept(statistics(keyword.summed_frequencies(embedded, "_df"), facts))
    return Index(key, embedded.drop("_size", "_df"), stats, facts.avgdl)


def with_words(chunks: DataFrame, text: str, tokenize: Tokenizer, with_text: bool) -> DataFrame:
    words = chunks.withColumn("words", tokenize(F.col(text)))
    return words if with_text else words.drop(text)


def embedded_chunks(chunks: DataFrame, dim: int, text: str = "content", embed: Embedder = search.hash_embeddings, tokenize: Tokenizer = tokens, with_text: bool = True) -> DataFrame:
    """chunks with ``words`` and ``embedding``, computed once; with_text: whether their text stays."""
    words = with_words(chunks, text, tokenize, with_text)
    return kept(embed(words, words.columns, "words", dim))


def facts_of(chunks: DataFrame, size: Column | None = None) -> Facts:
    """size: how many words a chunk has, where that is at hand; else ``words`` are counted."""
    size = F.greatest(F.size("words") if size is None else size, F.lit(0))
    return Facts(*chunks.agg(F.count("*"), F.count_if(size > 0), F.coalesce(F.sum(size), F.lit(0))).first())


def statistics(frequencies: DataFrame, facts: Facts) -> DataFrame:
    """``term, df, idf``."""
    return keyword.with_idf(frequencies, frequencies.sparkSession.createDataFrame([(float(facts.n),)], "n double"))


def sub_queries(queries: DataFrame, term_stats: DataFrame | None = None, rewrites: DataFrame | None = None, tokenize: Tokenizer = tokens) -> DataFrame:
    """``query_id, sub_idx, words``: the query, then its keywords (with term_stats) or else rewrites that differ from it.

    queries: ``query_id, text``; rewrites: ``query_id, place, text``. Equal rewrites stay, each a list of its own.
    """
    own = queries.select("query_id", F.lit(0).alias("sub_idx"), tokenize(F.coalesce("text", F.lit(""))).alias("words"))
    if term_stats is not None:
        asked = own.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
        best = keyword.keywords(asked, term_stats, ["query_id"])
        terms = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
        return own.unionByName(best.groupBy("query_id").agg(terms.alias("words")).select("query_id", F.lit(1).alias("sub_idx"), "words"))
    if rewrites is not None:
        new = rewrites.join(queries.select("query_id", F.col("text").alias("original")), "query_id").where(~F.col("text").eqNullSafe(F.col("original")))
        return own.unionByName(new.select("query_id", F.col("place").cast("int").alias("sub_idx"), tokenize(F.col("text")).alias("words")))
    return own


def terms_of(subs: DataFrame) -> DataFrame:
    """``query_id, sub_idx, term, qtf``."""
    return subs.select("query_id", "sub_idx", F.explode("words").alias("term")).groupBy("query_id", "sub_idx", "term").agg(F.count("*").alias("qtf"))


def fused_hits(index: Index, subs: DataFrame, config: Config, embed: Embedder = search.hash_embeddings) -> DataFrame:
    """The candidates of all sub-queries, fused: of all rows, of the cells that a sub-query probes or of what the beams of graphs meet, as the index has it."""
    by, k = ["query_id", "sub_idx"], 25 * config.top_k
    vectors = embed(subs, by, "words", config.embed_dim)
    if index.graphs is not None:
        hits = graph.search_graphs(index.graphs, index.key, vectors, k, config.hnsw_ef, by)
    elif index.cells is None:
        hits = search.exact_top_k(index.chunks, index.key, vectors, k, by)
    else:
        hits = search_cells(index.cells, index.key, assign_cells(vectors, by, index.centres, config.ivf_nprobe), k, by)
    if config.metric == "l2":
        hits = hits.withColumn("score", F.round(l2_score(F.col("score")), 9))
    return kept(search.fuse(hits, index.key))


def hybrid_search(index: Index, subs: DataFrame, config: Config, use_rerank: bool = True, parity: bool = False, embed: Embedder = search.hash_embeddings) -> DataFrame:
    """``query_id``, key, ``rank, score, vec_score, kw_score`` (null where keywords don't count).

    Without use_rerank all fused rows are returned by their fused score, without threshold or limit. Without a weight on keywords the
    score is that of the vectors, or with parity the fused one, which the threshold is held against then. An index without keywords is
    searched by vectors alone, whose order stays with parity.
    """
    fused = fused_hits(index, subs, config, embed)
    if not use_rerank:
        return search.by_fusion(fused, index.key)
    if config.kw_weight == 0 or index.term_stats is None:
        return search.by_vector(fused, index.key, config.threshold, config.top_k, parity, None if config.kw_weight == 0 else "vec_score")
    asked = kept(kept(terms_of(subs)).join(index.term_stats.select("term", "idf"), "term"))
    kw = keyword.row_scores(fused, index.chunks, asked, index.key, index.avgdl)
    return search.rerank(fused, kw, index.key, config.vec_weight, config.kw_weight, config.threshold, config.top_k)


def ideal_search(index: Index, queries: DataFrame, config: Config, embed: Embedder = search.hash_embeddings, tokenize: Tokenizer = tokens) -> DataFrame:
    """The best of all chunks for each query, none left out by a candidate search."""
    subs = sub_queries(queries, tokenize=tokenize)
    vectors = embed(subs, ["query_id"], "words", config.embed_dim)
    weights = kept(terms_of(subs).join(index.term_stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    return exhaustive.hybrid_top_k(index.chunks, index.key, vectors, weights, index.avgdl, config.vec_weight, config.kw_weight, config.threshold, config.top_k, config.metric)


def encode(rows: DataFrame, cache: DataFrame, model: str, dim: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``cache_key, embedding``, what the cache lacked). cache: ``cache_key, embedding``, a row for each key.

    Each text that the cache lacks is embedded once, however often it comes. A null text has the key of an empty one.
    """
    keyed = rows.withColumn("cache_key", cache_key(model, F.coalesce(text, F.lit(""))))
    lacking = keyed.groupBy("cache_key").agg(F.first(text).alias("t")).join(cache, "cache_key", "left_anti")
    made = kept(search.hash_embeddings(lacking.select("cache_key", tokens(F.col("t")).alias("t")), ["cache_key"], "t", dim))
    return keyed.join(cache.select("cache_key", "embedding").unionByName(made), "cache_key", "left"), made


def dense_ids(rows: DataFrame, key: list[str], start: int = 0, buckets: int | None = None) -> DataFrame:
    """rows with ``id``: start, start + 1 and so on, for keys that don't repeat; the same rows get the same ids.

    Rows are numbered within buckets by a hash of the key, of about a million rows each if no number is given; the buckets' sizes are summed up before.
    """
    buckets = buckets or 1 + rows.count() // 1_000_000
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("n"))
    base = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_bucket", F.coalesce(base, F.lit(0)).alias("_base"))
    within = F.row_number().over(W.partitionBy("_bucket").orderBy(*key))
    return placed.withColumn("_row", within).join(F.broadcast(sizes), "_bucket").withColumn("id", F.col("_base") + F.col("_row") + (start - 1)).drop("_bucket", "_base", "_row")
