"""Tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one where it names none and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="strataflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def spread(table: DataFrame) -> DataFrame:
    """A table as its files have it, dealt over all cores where its files have fewer splits than that; a table of many splits isn't shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder: it outlives executors, and later scans read the columns that they need."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/strataflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
