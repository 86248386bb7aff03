"""Keyword statistics and BM25 scores as joins over postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import places_of, word_slices

K1, B, FLOOR = 1.5, 0.75, 0.25

#: Up to so many candidates go to all rows, so that a search doesn't shuffle the rows' words; more of them meet their rows in a shuffle.
BROADCAST_CANDIDATES = 1 << 19


def postings(rows: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """key, ``term, tf``; a key has one row."""
    return postings_of_words(rows.select(*key, tokens(F.col(text)).alias("words")), key)


def postings_of_words(rows: DataFrame, key: list[str], words: str = "words") -> DataFrame:
    """key, ``term, tf`` of rows that have their words, a row for each key: counted where the row is, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                at, terms, tf = [], [], []
                for i, own in enumerate(batch.column(len(key)).to_pylist()):
                    counts = Counter(own or ())
                    at += [i] * len(counts)
                    terms += counts.keys()
                    tf += counts.values()
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(key)]), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=[*key, "term", "tf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return rows.select(*key, words).mapInArrow(run, f"{schema}, term string, tf long")


def doc_lengths(posts: DataFrame, key: list[str]) -> DataFrame:
    return posts.groupBy(*key).agg(F.sum("tf").alias("dl"))


def term_stats(posts: DataFrame, n_rows: DataFrame) -> DataFrame:
    """``term, df, idf`` of postings. n_rows: one row, ``n``."""
    return with_idf(posts.groupBy("term").agg(F.count("*").alias("df")), n_rows)


def frequencies(rows: DataFrame, words: str = "words") -> DataFrame:
    """``term, df``: in how many rows a word is; of several sets of rows they add up."""
    return rows.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def partial_frequencies(words: str) -> Column:
    """An array of ``term, df`` for about half a million words, with the first of their rows; the other rows' arrays are empty.

    It goes through Python with the other Arrow functions of these words. Which row has them depends on the batch, so the rows have to be
    stored before ``summed_frequencies`` adds the arrays up: a filter on the arrays would compute them anew, on other batches.
    """

    @F.arrow_udf("array<struct<term: string, df: bigint>>")
    def counted(words: pa.Array) -> pa.Array:
        sizes, terms, df = [], [], []
        for part in word_slices(words):
            coded = part.flatten().dictionary_encode()
            n = len(coded.dictionary)
            pairs = np.unique(places_of(part) * n + coded.indices.to_numpy())
            terms.append(coded.dictionary)
            df.append(np.bincount(pairs % max(1, n), minlength=n))
            sizes += [n, *[0] * (len(part) - 1)]
        own = pa.StructArray.from_arrays([pa.concat_arrays(terms), pa.array(np.concatenate(df), pa.int64())], names=["term", "df"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), own)

    return counted(F.col(words))


def summed_frequencies(rows: DataFrame, partial: str) -> DataFrame:
    """``term, df``, as ``frequencies`` has it, of a stored table with a column of ``partial_frequencies``."""
    return rows.select(F.inline(partial)).groupBy("term").agg(F.sum("df").alias("df"))


def with_idf(df: DataFrame, n_rows: DataFrame) -> DataFrame:
    """``term, df, idf``; negative idf becomes a quarter of the mean over all terms. n_rows: one row, ``n``."""
    raw = df.crossJoin(F.broadcast(n_rows)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(candidates: DataFrame, posts: DataFrame, stats: DataFrame, lengths: DataFrame, query_terms: DataFrame, key: list[str], n_avg: DataFrame) -> DataFrame:
    """``query_id``, key, ``kw`` of the candidates (``query_id``, key) that share a term with their query.

    Terms that a query repeats count as often. query_terms: ``query_id, term, qtf``, and ``sub_idx`` where a query has several parts, of
    which the best counts; n_avg: one row, ``avgdl``. Postings meet the candidates before the query terms, so that a frequent term gives
    rows for candidates only.
    """
    sub = [c for c in ("sub_idx",) if c in query_terms.columns]
    asked = query_terms.join(stats.select("term", "idf"), "term")
    found = candidates.select("query_id", *key).join(posts, key).join(asked, ["query_id", "term"]).join(lengths, key).crossJoin(F.broadcast(n_avg))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = found.groupBy("query_id", *key, *sub).agg(F.sum(part).alias("kw"))
    return scores.groupBy("query_id", *key).agg(F.max("kw").alias("kw")) if sub else scores


def row_scores(candidates: DataFrame, rows: DataFrame, asked: DataFrame, key: list[str], avgdl: float) -> DataFrame:
    """``query_id``, key, ``kw`` of the candidates that share a term with their query, as ``bm25`` has it, counted in the words of their own rows.

    rows: key, ``words``; asked: ``query_id, sub_idx, term, qtf, idf``. No postings take part, so the work is that of the candidates' words.
    candidates are counted first, so they should be a stored table.
    """
    chosen = candidates.select("query_id", *key)
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CANDIDATES else chosen
    own = chosen.join(rows.select(*key, "words"), key)
    words = own.select("query_id", *key, F.size("words").alias("dl"), F.explode("words").alias("term"))
    counts = words.join(asked, ["query_id", "term"]).groupBy("query_id", *key, "dl", "sub_idx", "term", "qtf", "idf").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    return counts.groupBy("query_id", *key, "sub_idx").agg(F.sum(part).alias("kw")).groupBy("query_id", *key).agg(F.max("kw").alias("kw"))


def keywords(posts: DataFrame, stats: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """The k terms of each row with the highest tf x idf."""
    from pyspark.sql import Window as W

    scored = posts.join(stats.select("term", "idf"), "term").withColumn("weight", F.round(F.col("tf") * F.col("idf"), 6))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, "rank", "term", "weight")
