"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast and driver-held tables stay below this many bytes; beyond it every operator has another way.
BROADCAST_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``rid, doc_id, text``: one row for each row of docs, a null text as an empty one, other columns left out.

    The columns named in carry go along inside a struct ``carried``, so that no name can clash.

    rid tells rows apart where doc_id repeats or is null. It is fixed by the scan's partitioning,
    so a recomputed task gives the same ids.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """docs, if its rows are known by their files and their places in these; what isn't read from Parquet files is written first."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs)


def placed(docs: DataFrame, *columns) -> DataFrame:
    """``file, rid`` and the columns: a hash of the file that each row is read from, and its place there.

    Several scans know rows by these: they stay the same when executors come or go and scans are cut otherwise.
    """
    return scanned(docs).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("rid"), *columns)


def placed_texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``file, rid, doc_id, text``, and ``carried``: keyed texts for several scans."""
    return placed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))


def carried_schema(texts: DataFrame) -> str:
    """What a function over keyed texts adds to its schema for the columns that go along."""
    return f", carried {texts.schema['carried'].dataType.simpleString()}" if "carried" in texts.columns else ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where all run in one process and the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="strataflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder, which a lost executor doesn't take along."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/strataflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def head_threshold(counts: DataFrame, column: str, at_most: int) -> int:
    """The smallest power of two such that at most ``at_most`` rows have a count of it or more."""
    sizes = counts.groupBy(F.floor(F.log2(F.col(column))).cast("int").alias("b")).count().collect()
    total, least = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["b"]):
        total += row["count"]
        if total > at_most:
            break
        least = 1 << row["b"]
    return least


def join_dealt(rows: DataFrame, table: DataFrame, key: str, n_rows: int, per: int = 10_000, stored: bool = False) -> DataFrame:
    """rows joined with a table that has one row a key, and the key's number of rows as ``weight``.

    Keys of more than one in ``per`` of all rows, of which there are fewer than ``per``, are broadcast, so that no task gathers the rows of one.
    stored: the table is a written one, whose hot keys needn't be written once more.
    """
    hot = table.where(F.col("weight") * per > n_rows)
    hot = hot if stored else written(hot)
    dealt = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("weight") * per <= n_rows), key)
    return dealt.unionByName(rows.join(F.broadcast(hot), key))


# --- words and rolling hashes over a buffer of bytes ---

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_tables: dict = {}


def _byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _tables["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    if "powers" not in _tables or len(_tables["powers"][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p, dtype=np.uint64))
        _tables["powers"] = tuple(made)
    return _tables["powers"][0][:n], _tables["powers"][1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for each pair; equal bytes give equal hashes, wherever they stand."""
    up, down = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[buf] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of words, once lower-cased: 0-9, a-z and characters beyond ASCII; or all but the space and 0x09 to 0x0D.
LETTERS_AND_DIGITS = np.array([b >= 0x80 or 0x30 <= b < 0x3A or 0x61 <= b < 0x7B for b in range(256)])
BLANK_SEPARATED = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def word_ranges(lowered: np.ndarray, of_word: np.ndarray = LETTERS_AND_DIGITS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that words are made of."""
    is_word = np.zeros(len(lowered) + 2, dtype=np.int8)
    is_word[1:-1] = of_word[lowered]
    step = np.diff(is_word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
