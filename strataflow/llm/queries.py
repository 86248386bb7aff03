"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_repair, chat_tree, cover_search, decontaminate, hmm_lm, line_dedup, mjpeg, periodic_runs, simhash_dedup, substring_dedup, token_counts, toxicity
from .oracle import ORACLE_SQL
from .shared import documents

def _fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"), learn_from=_fold() != 0)
    return scored.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm_lm.score_texts(documents(spark, sf_dir), train_on=_fold() != 1)
    return scored.select("doc_id", F.coalesce(_fold() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    return chat_tree.digests(chat_tree.read_back(*chat_tree.pack(rows.unionByName(more))))


def op6_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.digests(mjpeg.decode(mjpeg.encode(documents(spark, sf_dir))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(documents(spark, sf_dir), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir), words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.digests(bpe_codec.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), cover_search.whole(F.col("embedding")).alias("v"))
    return cover_search.top_products(vectors, F.col("vec_id") % 50 == 0, k=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(documents(spark, sf_dir), periodic_runs.repeated))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_token_counts, op3_decontaminate, op4_hmm_lm, op5_chat_tree, op6_mjpeg, op7_substring_dedup, op8_line_dedup, op9_simhash_dedup, op10_bpe_codec, op11_chat_repair, op12_cover_search, op13_periodic_runs)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
