"""Indexes as immutable Parquet tables under a manifest, and a registry of their names.

An index is a list of segments and of removals, in the order in which they came. What is written gets a folder of its own; then one row with
the list is added to the manifest, which makes a new version. Readers take the last version, so they see all of a change or nothing of it, and a
change that fails in between leaves the version before readable. Of writers that make the same version at the same time one wins, and the others get an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the registry says of an index that is no more.
DELETED = "{}"


class ConcurrentChange(RuntimeError):
    """Another writer made the same version first."""


class IndexStore:
    """Indexes below a folder, by name. All access goes through Spark, so that any of its file systems will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _delete_folder(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- versions ---

    def write(self, name: str, tables: dict[str, DataFrame]) -> str:
        """Tables in a folder of their own, which no reader knows until a version names it."""
        part = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/parts/{part}/{table}")
        return part

    def table(self, name: str, part: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/parts/{part}/{table}")

    def state(self, name: str) -> tuple[int, dict]:
        """The last version and what it lists."""
        rows = self._read(f"{self.root}/{name}/manifest")
        last = rows and rows.orderBy(F.desc("version"), "writer").select("version", "state").first()
        if not last or not json.loads(last["state"]):
            raise FileNotFoundError(f"no index named {name}")
        return last["version"], json.loads(last["state"])

    def commit(self, name: str, before: int, state: dict) -> int:
        """A version after the one before; the state is a JSON object, and an empty one is no index."""
        writer, version, path = uuid.uuid4().hex, before + 1, f"{self.root}/{name}/manifest"
        row = self.spark.createDataFrame([(version, writer, json.dumps(state, ensure_ascii=False))], "version long, writer string, state string")
        row.coalesce(1).write.mode("append").parquet(path)
        if self.spark.read.parquet(path).where(F.col("version") == version).agg(F.min("writer")).first()[0] != writer:
            raise ConcurrentChange(f"version {version} of {name} was made by another writer")
        return version

    def version(self, name: str) -> int:
        """The last version, 0 if there has been none; an index that was deleted has one."""
        rows = self._read(f"{self.root}/{name}/manifest")
        return (rows.agg(F.max("version")).first()[0] if rows else 0) or 0

    def live(self, name: str, state: dict, table: str) -> DataFrame:
        """The rows of all segments' tables that no later removal names. A segment's rows are its own where their document was removed before it came."""
        rows = None
        for s in state["segments"]:
            own = self.table(name, s["part"], table).withColumn("_order", F.lit(s["order"]))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if state["removed"]:
            gone = None
            for r in state["removed"]:
                own = self.table(name, r["part"], "removed").select("doc_id", F.lit(r["order"]).alias("_gone"))
                gone = own if gone is None else gone.unionByName(own)
            gone = gone.groupBy("doc_id").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["_order"] < gone["_gone"]), "left_anti")
        return rows.drop("_order")

    def vacuum(self, name: str) -> int:
        """Deletes the folders that the last version doesn't name, which no search of an older one may be using any more; their number."""
        _, state = self.state(name)
        used = {state["stats"], state.get("centres"), *(x["part"] for x in (*state["segments"], *state["removed"]))}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{name}/parts").select(F.regexp_extract("path", r"/parts/([0-9a-f]{32})/", 1).alias("part"))
        unused = [r["part"] for r in files.distinct().collect() if r["part"] and r["part"] not in used]  # a row for each change since the last time
        for part in unused:
            self._delete_folder(f"{self.root}/{name}/parts/{part}")
        return len(unused)

    # --- names ---

    def register(self, name: str, **info: str) -> None:
        self._entry(name, json.dumps(info, sort_keys=True, ensure_ascii=False))

    def _entry(self, name: str, info: str) -> None:
        row = self.spark.createDataFrame([(name, info)], "name string, info string").withColumn("created", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/registry")

    def list(self) -> DataFrame:
        """``name, info, created``: the last entry of each name that hasn't been deleted since."""
        entries = self._read(f"{self.root}/registry")
        if entries is None:
            return self.spark.createDataFrame([], "name string, info string, created timestamp")
        last = entries.groupBy("name").agg(F.max_by("info", "created").alias("info"), F.max("created").alias("created"))
        return last.where(F.col("info") != DELETED)

    def dump(self, name: str) -> DataFrame:
        """All chunks without their words and vectors: what an index holds, for a look or a copy."""
        return self.live(name, self.state(name)[1], "chunks").drop("embedding", "words")

    def delete(self, name: str) -> bool:
        """Whether there was such an index. Its last version is an empty one; then its tables are deleted."""
        try:
            version, _ = self.state(name)
        except FileNotFoundError:
            return False
        self.commit(name, version, {})
        self._entry(name, DELETED)
        self._delete_folder(f"{self.root}/{name}/parts")
        return True

    def clear(self) -> int:
        """Deletes all indexes; their number."""
        names: Iterable = self.list().select("name").toLocalIterator()
        return sum(self.delete(r["name"]) for r in names)
