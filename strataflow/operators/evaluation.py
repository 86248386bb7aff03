"""Retrieval quality against an exact ideal set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recalls(actual: DataFrame, ideal: DataFrame, queries: DataFrame, key: list[str]) -> DataFrame:
    """``query_id, retrieved, ideal, precision_recall, relevance_recall`` for all queries.

    No ideal rows: precision 1. No ideal score: relevance 1 if nothing was retrieved, else 0.
    """
    a = actual.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.sum("score").alias("a_sum"))
    i = ideal.groupBy("query_id").agg(F.count("*").alias("ideal"), F.sum("score").alias("i_sum"))
    both = actual.join(ideal.select("query_id", *key), ["query_id", *key], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = queries.select("query_id").join(a, "query_id", "left").join(i, "query_id", "left").join(both, "query_id", "left").na.fill(0)
    precision = F.when(F.col("ideal") == 0, 1.0).otherwise(F.col("hits") / F.col("ideal"))
    relevance = F.when(F.col("i_sum") == 0, F.when(F.col("a_sum") == 0, 1.0).otherwise(0.0)).otherwise(F.col("a_sum") / F.col("i_sum"))
    return rows.select("query_id", "retrieved", "ideal", F.round(precision, 6).alias("precision_recall"), F.round(relevance, 6).alias("relevance_recall"))


def batch_means(rows: DataFrame) -> DataFrame:
    """``mode, n_queries, mean_precision, mean_relevance, retrieved`` of recalls with a ``mode``, the most precise mode first."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = rows.groupBy("mode").agg(F.count("*").alias("n_queries"), mean("precision_recall", "mean_precision"), mean("relevance_recall", "mean_relevance"), F.sum("retrieved").alias("retrieved"))
    return out.orderBy(F.desc("mean_precision"), "mode")


def summary_line(rows: DataFrame) -> DataFrame:
    """``query_id, summary``: the recalls as text."""
    line = F.format_string("precision recall %.2f%% (%d of %d), relevance recall %.4f", F.col("precision_recall") * 100, F.round(F.col("precision_recall") * F.col("ideal")).cast("long"), F.col("ideal"), F.col("relevance_recall"))
    return rows.select("query_id", line.alias("summary"))
