"""Neighbours, similar rows and reports over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def context_windows(chunks: DataFrame, window: int = 2) -> DataFrame:
    """``doc_id, sequence, n_context, context``: each chunk with those around it in its document, as they come."""
    w = W.partitionBy("doc_id").orderBy("sequence").rowsBetween(-window, window)
    around = F.collect_list("sequence").over(w)
    return chunks.select("doc_id", "sequence", F.size(around).cast("long").alias("n_context"), F.array_join(F.transform(around, lambda x: x.cast("string")), ",").alias("context"))


def neighbours(chunks: DataFrame, selected: DataFrame, window: int = 1) -> DataFrame:
    """Chunks of selected ``doc_id, at`` whose sequence is within window of at (an equi-join on the sequence)."""
    wanted = selected.select("doc_id", "at", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)).alias("sequence"))
    return chunks.join(wanted.distinct(), ["doc_id", "sequence"])


def with_context(results: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """results (``query_id, doc_id, sequence`` and more) with ``context``: the texts of the chunks within window of each, in order."""
    around = results.select("query_id", "doc_id", "sequence", F.explode(F.sequence(F.col("sequence") - window, F.col("sequence") + window)).alias("at"))
    near = around.join(chunks.select("doc_id", F.col("sequence").alias("at"), "content"), ["doc_id", "at"])
    texts = near.groupBy("query_id", "doc_id", "sequence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("context"))
    return results.join(texts, ["query_id", "doc_id", "sequence"], "left")


def by_position(chunks: DataFrame, doc_id: int | None = None, sequence: int | None = None) -> DataFrame:
    for name, value in (("doc_id", doc_id), ("sequence", sequence)):
        chunks = chunks if value is None else chunks.where(F.col(name) == value)
    return chunks


def origin(strategy: str = "chunking_strategy", element: str = "element_type"):
    # Labels by the chunk's metadata.
    return (
        F.when(F.col(element) == "SummaryNode_LLM", "LLM 生成 (RAPTOR 摘要)")
        .when(F.col(strategy) == "tabular_summary_codespace", "LLM 生成 (表格摘要)")
        .when(F.col(strategy) == "tabular_row_based_semantic", "表格行转换 (程序化语义)")
        .otherwise("原始文档 (文本分块)")
    )


def report_sections(chunks: DataFrame) -> DataFrame:
    """``doc_id, n_chunks, section``: each document's part of a report on where its chunks come from, in order of level and place.

    chunks: ``doc_id, level, sequence, chunk_id_str, content, origin`` and ``children`` (ids, may be null or empty).
    """
    # The report's labels.
    children = F.when(F.size(F.coalesce("children", F.array().cast("array<string>"))) > 0, F.concat(F.lit("- **参考块:** "), F.array_join(F.transform("children", lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", "), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("### 块 - 整数ID: `"), F.col("sequence").cast("string"), F.lit("` | 字符串ID: `"), F.col("chunk_id_str"), F.lit("`\n- **来源:** "), F.col("origin"), F.lit("\n"),
        children, F.lit("- **内容:**\n```\n"), F.col("content"), F.lit("\n```"),
    )
    rows = chunks.select("doc_id", F.struct("level", "sequence", "chunk_id_str", block.alias("block")).alias("x"))
    by_document = rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list("x")).alias("x"))
    return by_document.select("doc_id", "n_chunks", F.concat(F.lit("\n## 文档: "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(F.col("x")["block"], "\n")).alias("section"))


def write_report(sections: DataFrame, path: str, name: str) -> None:
    """A heading and the documents' sections in order, as text files whose names follow that order."""
    total = sections.agg(F.sum("n_chunks")).first()[0] or 0
    head = sections.sparkSession.createDataFrame([(None, f"# RAG模式 '{name}' 知识库溯源报告\n**总块数:** {total}\n\n---\n")], f"doc_id {sections.schema['doc_id'].dataType.simpleString()}, section string")
    head.unionByName(sections.select("doc_id", "section")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("section").write.mode("overwrite").text(path)


def prompt_texts(sources: Column, path: str = "未知路径") -> Column:
    """What a language model is given of each source (``rank, doc_id, sequence, content``): its document, path and text."""
    # The labels, and what stands for a path that isn't known.
    return F.transform(sources, lambda s: F.concat(F.lit("来源文档: "), s["doc_id"].cast("string"), F.lit(f"\n文件路径: {path}\n内容: "), s["content"]))
