"""Indexes by name: built from documents, changed, searched, asked and evaluated in batches of queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import tokens
from .operators import chunking, context, evaluation, graph, keyword, retrieval, search, tree
from .operators import index as cells
from .operators.segmentation import Tokenizer
from .plans.config import Config, update_plan
from .sources.store import IndexStore
from .sources.stored import kept

KEY = ["doc_id", "sequence"]
# What is said without hits, and without a language model.
NOTHING_FOUND, NO_MODEL = "抱歉，在知识库中找不到与您问题相关的信息。", "未配置语言模型"


class Engine:
    """All state is in the store; a name can be built, searched and dropped from any session."""

    def __init__(
        self, spark: SparkSession, root: str, answer: Callable[[str, list[str]], str] | None = None, embed: retrieval.Embedder = search.hash_embeddings,
        summarise: Callable[[list[str]], str] = tree.first_words, tokenize: Tokenizer = tokens,
    ):
        """answer: a question and texts to an answer; embed: the embedding of rows of words; summarise: texts to a summary; tokenize: a text column to its words."""
        self.spark, self.store, self.answer, self.embed, self.summarise, self.tokenize = spark, IndexStore(spark, root), answer, embed, summarise, tokenize

    # --- building and changing ---

    def build(self, name: str, docs: DataFrame, config: Config, replace: bool = False) -> None:
        """docs: ``doc_id, text``. An index that exists is only replaced if asked to, and searched until the new one is whole."""
        if not replace and self.exists(name):
            raise FileExistsError(f"there is an index named {name}")
        self._commit_whole(name, self._embedded(docs, config), config)
        self.store.register(name, mode=config.mode_name, index_type=config.index_type, metric=config.metric)

    def _chunks(self, docs: DataFrame, config: Config) -> DataFrame:
        chunks = chunking.chunk_documents(docs, config.proc_chunk_token_size).select(*KEY, F.lit(0).alias("level"), "content")
        if config.proc_enable_raptor:
            chunks = kept(chunks)
            nodes = tree.summary_tree(chunks, self.summarise, config.proc_raptor_max_clusters).where("level > 0")
            # Summaries come before the document's chunks: their sequence numbers are negative, the further up the smaller.
            order = F.row_number().over(W.partitionBy("doc_id").orderBy("level", "node"))
            chunks = chunks.unionByName(nodes.select("doc_id", (-order).alias("sequence"), "level", "content"))
        return chunks

    def _embedded(self, docs: DataFrame, config: Config) -> DataFrame:
        return retrieval.embedded_chunks(self._chunks(docs, config), config.embed_dim, embed=self.embed, tokenize=self.tokenize)

    def _segment(self, name: str, chunks: DataFrame, config: Config, centres: np.ndarray | None, order: int) -> tuple[dict, retrieval.Facts]:
        """A written segment of embedded chunks as the manifest lists it."""
        tables = {"chunks": chunks}
        if config.index_type == "IVF":
            tables["cells"] = cells.assign_cells(chunks, [*KEY, "level"], centres).repartitionByRange("cell").sortWithinPartitions("cell")
        if config.index_type == "HNSW":
            tables["graphs"] = graph.graphs(chunks, KEY, config.hnsw_m, config.hnsw_ef_con)
        return {"part": self.store.write(name, tables), "order": order}, retrieval.facts_of(chunks)

    def _commit_whole(self, name: str, chunks: DataFrame, config: Config) -> None:
        """One segment in place of all there was."""
        version, centres, part = self.store.version(name), None, None
        if config.index_type == "IVF":
            centres = cells.fit_cells(chunks, config.ivf_nlist)
            part = self.store.write(name, {"centres": self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")})
        segment, facts = self._segment(name, chunks, config, centres, version + 1)
        stats = self.store.write(name, {"term_stats": retrieval.statistics(keyword.frequencies(chunks), facts)})
        self.store.commit(name, version, {"config": config.to_json(), "segments": [segment], "removed": [], "stats": stats, "facts": asdict(facts), "centres": part})

    def append(self, name: str, docs: DataFrame) -> int:
        """Adds documents; those whose doc_id the index has take the place of the old ones. The new version.

        The work is that of the documents and of the vocabulary's statistics. Results are those of an index that is built anew from all documents,
        but for cells, whose centres stay until ``compact``.
        """
        version, state = self.store.state(name)
        config = Config.from_json(state["config"])
        docs = kept(docs.select("doc_id", "text"))
        state, stats, facts = self._without(name, state, version, docs.select("doc_id"))
        new = self._embedded(docs, config)
        centres = self._centres(name, state) if state["centres"] else None
        segment, own = self._segment(name, new, config, centres, version + 1)
        return self._commit_change(name, version, state | {"segments": [*state["segments"], segment]}, stats.unionByName(keyword.frequencies(new)), facts.plus(own))

    def remove(self, name: str, ids: DataFrame) -> int:
        """Removes documents (``doc_id``); unknown ones don't matter. The new version. Their rows stay in the tables until ``compact``."""
        version, state = self.store.state(name)
        return self._commit_change(name, version, *self._without(name, state, version, ids))

    def _without(self, name: str, state: dict, version: int, ids: DataFrame) -> tuple[dict, DataFrame, retrieval.Facts]:
        """The state, frequencies (which add up by term) and facts without some documents."""
        live = self.store.live(name, state, "chunks")
        gone = kept(live.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "words"))
        stats, facts = self.store.table(name, state["stats"], "term_stats").select("term", "df"), retrieval.Facts(**state["facts"])
        own = retrieval.facts_of(gone)
        if own.n:
            part = self.store.write(name, {"removed": gone.select("doc_id").distinct()})
            state = state | {"removed": [*state["removed"], {"part": part, "order": version + 1}]}
            stats = stats.unionByName(keyword.frequencies(gone).withColumn("df", -F.col("df")))
        return state, stats, facts.plus(own, -1)

    def _commit_change(self, name: str, version: int, state: dict, frequencies: DataFrame, facts: retrieval.Facts) -> int:
        summed = frequencies.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
        stats = self.store.write(name, {"term_stats": retrieval.statistics(kept(summed), facts)})
        return self.store.commit(name, version, state | {"stats": stats, "facts": asdict(facts)})

    def compact(self, name: str, vacuum: bool = False) -> None:
        """All segments as one, without what was removed, cells and graphs made anew; vacuum deletes the files that the version before had."""
        _, state = self.store.state(name)
        self._commit_whole(name, kept(self.store.live(name, state, "chunks")), Config.from_json(state["config"]))
        if vacuum:
            self.store.vacuum(name)

    def exists(self, name: str) -> bool:
        try:
            self.store.state(name)
        except FileNotFoundError:
            return False
        return True

    def _centres(self, name: str, state: dict) -> np.ndarray:
        return np.array([r["centre"] for r in self.store.table(name, state["centres"], "centres").orderBy("cell").collect()])  # ivf_nlist rows

    def load(self, name: str) -> tuple[retrieval.Index, Config]:
        """The last version: what is changed afterwards doesn't show in it."""
        _, state = self.store.state(name)
        config = Config.from_json(state["config"])
        own, centres, graphs = None, None, None
        if config.index_type == "IVF" and state["centres"]:
            own, centres = self.store.live(name, state, "cells"), self._centres(name, state)
        # Graphs have no way to leave out documents: until they are made anew by ``compact`` all rows are searched.
        if config.index_type == "HNSW" and not state["removed"]:
            graphs = self.store.live(name, state, "graphs")
        chunks = self.store.live(name, state, "chunks")
        return retrieval.Index(KEY, chunks, self.store.table(name, state["stats"], "term_stats"), retrieval.Facts(**state["facts"]).avgdl, own, centres, graphs), config

    def ensure(self, name: str, docs: DataFrame, config: Config) -> None:
        """Builds what doesn't exist."""
        if not self.exists(name):
            self.build(name, docs, config)

    def update(self, name: str, docs: DataFrame, config: Config) -> str:
        """``rebuild`` if the settings ask for a new index, which is built, else ``hot``: they are put in place."""
        plan = update_plan(self.load(name)[1] if self.exists(name) else None, config)
        if plan == "rebuild":
            self.build(name, docs, config, replace=True)
        else:
            version, state = self.store.state(name)
            self.store.commit(name, version, state | {"config": config.to_json()})
            self.store.register(name, mode=config.mode_name, index_type=config.index_type, metric=config.metric)
        return plan

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The ``name`` rows that aren't in the registry."""
        return wanted.join(self.store.list(), "name", "left_anti")

    def search(self, name: str, queries: DataFrame, keywords: bool = False, rewrites: DataFrame | None = None, use_rerank: bool = True, where: Column | None = None, **changes) -> DataFrame:
        """``query_id, doc_id, sequence, rank, score, vec_score, kw_score, content``. queries: ``query_id, text``.

        keywords adds the five leading terms as a sub-query, in place of rewrites. where: a condition on ``doc_id, sequence, level`` that
        all results meet, held before the best are chosen, so that top_k rows are found where there are as many. changes: settings for this search only.
        """
        index, config = self.load(name)
        index = index.where(where)
        subs = retrieval.sub_queries(queries, index.term_stats if keywords else None, rewrites, self.tokenize)
        found = retrieval.hybrid_search(index, subs, config.updated(**changes), use_rerank, embed=self.embed)
        return found.join(index.chunks.select(*KEY, "content"), KEY)

    def ask(self, name: str, queries: DataFrame, **options) -> DataFrame:
        """``query_id, answer, sources``: the texts of a query's results (at most top_k) go to the language model together."""
        found = self.search(name, queries, **options).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "sequence", "content"))).alias("sources"))
        rows = queries.select("query_id", "text").join(found, "query_id", "left")
        if self.answer is None:
            return rows.select("query_id", F.when(F.col("sources").isNull(), NOTHING_FOUND).otherwise(NO_MODEL).alias("answer"), "sources")
        model, query_type = self.answer, queries.schema["query_id"].dataType.simpleString()
        asked = kept(rows.select("query_id", "text", context.prompt_texts(F.col("sources")).alias("texts"), "sources"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = [model(q, texts) if texts else NOTHING_FOUND for q, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["query_id", "answer"])

        # A query is a call of the model: few to a task.
        answers = asked.select("query_id", "text", "texts").mapInArrow(run, f"query_id {query_type}, answer string")
        return answers.join(asked.select("query_id", "sources"), "query_id")

    def evaluate(self, name: str, queries: DataFrame) -> DataFrame:
        index, config = self.load(name)
        found = retrieval.hybrid_search(index, retrieval.sub_queries(queries, tokenize=self.tokenize), config, embed=self.embed)
        return evaluation.recalls(found, retrieval.ideal_search(index, queries, config, self.embed, self.tokenize), queries, KEY)

    def compare(self, names: list[str], queries: DataFrame) -> DataFrame:
        """Mean recalls of several indexes, the most precise first."""
        rows = None
        for name in names:
            own = self.evaluate(name, queries).withColumn("mode", F.lit(name))
            rows = own if rows is None else rows.unionByName(own)
        return evaluation.batch_means(rows)

    def delete(self, name: str) -> bool:
        """Whether there was such an index."""
        return self.store.delete(name)

    def clear(self) -> int:
        """Deletes all indexes; their number."""
        return self.store.clear()

    def info(self, name: str) -> DataFrame:
        """One row: ``name, n_chunks, n_summaries, n_docs, dim, index_type, metric, n_cells``."""
        index, config = self.load(name)
        found = index.chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("level") > 0).alias("n_summaries"), F.countDistinct("doc_id").alias("n_docs"), F.max(F.size("embedding")).alias("dim"))
        cells = 0 if index.centres is None else len(index.centres)
        return found.select(F.lit(name).alias("name"), "*", F.lit(config.index_type).alias("index_type"), F.lit(config.metric).alias("metric"), F.lit(cells).alias("n_cells"))

    def ensure_all(self, docs: DataFrame, configs: dict[str, Config]) -> dict[str, str]:
        """Builds what doesn't exist; by name ``built``, ``exists`` or what went wrong, which doesn't stop the others."""
        out = {}
        for name, config in configs.items():
            try:
                out[name] = "exists" if self.exists(name) else "built"
                self.ensure(name, docs, config)
            except Exception as e:  # whatever a user's embedding or summaries may raise
                out[name] = f"{type(e).__name__}: {e}"
        return out

    def measure(self, name: str, queries: DataFrame) -> dict:
        """Mean recalls of a batch of queries, its time and the settings that it was searched with."""
        began = time.monotonic()
        means = evaluation.batch_means(self.evaluate(name, queries).withColumn("mode", F.lit(name))).first()
        seconds = time.monotonic() - began
        n = means["n_queries"] if means else 0
        return {**(means.asDict() if means else {}), "total_time": seconds, "mean_time": seconds / n if n else 0.0, "config": asdict(self.load(name)[1])}
