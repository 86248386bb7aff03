"""A corpus pipeline of five stages, each over what its predecessor kept.

toxicity: documents that the model rejects go. line_dedup: lines that recur go, but for the last document's. near_dedup: one document
of each group stays, that of the smallest doc_id. decontamination: documents with benchmark words go. tokens: ids of the texts.

The near-duplicate stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: SimHash fingerprints
find the candidates, the whole sets verify them. A document without words has nothing to be a copy of: that stage keeps it.

Null texts stay null until tokens, where they have no ids. Rows are told apart by file and row, so repeated rows are copies of each other and
null ids are kept like others (of a group, the smallest id stays; null comes last). Empty tables: no rows. Very long texts go through whole: a
text is in one task at a time. Ties of ids are settled by file and row. Further columns of docs are left out after the first stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import bpe_codec, decontaminate, line_dedup, simhash_dedup, toxicity
from strataflow.llm.shared import BROADCAST_BYTES, placed, scanned, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bitmaps of 32,768 rows; they are broadcast up to so many bytes, which is half a billion documents.
BITMAP_BYTES = 4096
GONE_BYTES = BROADCAST_BYTES

#: The trained model and the fingerprints can't be expressed in SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels of every fifth document are left for measuring."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    machine = toxicity.train(toxicity.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn))
    return toxicity.score(docs, machine, carry=COLUMNS).where(F.col("score") < 0.5).select("carried.*")


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without recurring lines; a null text stays null."""
    kept = line_dedup.line_dedup(docs.withColumn("no_text", F.col("text").isNull()), carry=("doc_id", "lang", "source", "n_chars", "no_text"))
    text = F.when(~F.col("carried.no_text"), F.col("kept"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return kept.select("doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that the links connect, and all documents without words.

    The rows that go are broadcast as bitmaps of at most ``GONE_BYTES``; if there are more, the texts are shuffled to meet them.
    """
    docs = scanned(docs.select(*COLUMNS))
    found = written(simhash_dedup.near_copies(docs, words=5))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "rid")).alias("first")).select("first.file", "first.rid")
    gone = written(found.join(first, ["file", "rid"], "left_anti").select("file", "rid"))
    rows = placed(docs, *COLUMNS)
    block, bit = F.bitmap_bucket_number(F.col("rid") + 1).alias("block"), F.bitmap_bit_position(F.col("rid") + 1)
    bitmaps = written(gone.groupBy("file", block).agg(F.bitmap_construct_agg(bit).alias("bits")))
    if bitmaps.count() * BITMAP_BYTES > GONE_BYTES:
        return rows.join(gone, ["file", "rid"], "left_anti").select(*COLUMNS)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_gone = F.col("bits").isNotNull() & (byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0)
    return rows.withColumn("block", block).join(F.broadcast(bitmaps), ["file", "block"], "left").where(~is_gone).select(*COLUMNS)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of a benchmark window; a null text stays null. A text goes through the tasks once, not beside a copy of itself."""
    docs = docs.withColumn("no_text", F.col("text").isNull())
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("lang", "source", "n_chars", "no_text"), with_text=True)
    return found.where(F.col("n_hit") == 0).select("doc_id", F.when(~F.col("carried.no_text"), F.col("text")).alias("text"), "carried.lang", "carried.source", "carried.n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to its bytes."""
    encoded = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxic_out), ("line_dedup", lines_out), ("near_dedup", copies_out), ("decontamination", leaks_out), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if i + 1 < len(STAGES) else docs
    return docs
