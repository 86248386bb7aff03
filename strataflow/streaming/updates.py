"""A chunk table that follows a stream of documents: new ones are added, changed ones replaced, those without text removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents


def follow(docs: DataFrame, root: str, checkpoint: str, size: int = 256, **trigger) -> StreamingQuery:
    """Writes the chunks of each batch of a stream of ``doc_id, text``, and which documents it held.

    A batch overwrites its own folders only, so that one that is repeated after a failure leaves the same rows. Of several rows of a
    document in one batch the one with the greatest text stays, as a stream's batches have no order within.
    """

    def take(batch: DataFrame, at: int) -> None:
        last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc_nulls_last("text")))
        own = batch.select("doc_id", "text").withColumn("k", last).where("k = 1").drop("k").persist()
        chunk_documents(own, size).write.mode("overwrite").parquet(f"{root}/chunks/batch={at}")
        own.select("doc_id").write.mode("overwrite").parquet(f"{root}/docs/batch={at}")
        own.unpersist()

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, sequence, chunk_id_str, content`` of each document's last batch."""
    last = spark.read.parquet(f"{root}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{root}/chunks").join(last, ["doc_id", "batch"]).drop("batch")
