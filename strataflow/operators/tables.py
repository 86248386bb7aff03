"""Tables to chunks: a sentence for each row, or one summary with the table's columns and first rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MISSING_CELL, row_sentence
from ..sources.stored import kept


def numbered(rows: DataFrame, order: list[str], out: str = "sequence") -> DataFrame:
    """rows with their places (from 0) in the order of some columns, which are distinct: numbers within ranges plus the ranges before."""
    ranged = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    base = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(base, F.lit(0)).alias("_base"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_row", within).join(F.broadcast(sizes), "_part").withColumn(out, F.col("_base") + F.col("_row") - 1).drop("_part", "_base", "_row")


def row_chunks(table: DataFrame, name: str, order: list[str], columns: list[str] | None = None, at: int = 0) -> DataFrame:
    """``doc_id, sequence, level, chunk_id_str, content``: each row as a sentence, missing cells filled; at: the table's place in its document."""
    columns = columns or table.columns
    rows = numbered(table, order)
    key = F.concat(F.lit(f"{name}_table{at}_row_"), F.col("sequence").cast("string"))
    return rows.select(F.lit(name).alias("doc_id"), "sequence", F.lit(0).alias("level"), key.alias("chunk_id_str"), row_sentence(name, {c: F.col(f"`{c}`") for c in columns}).alias("content"))


def plain_summary(name: str, columns: list[str], n_rows: int) -> str:
    """The summary without a language model."""
    return f"表格“{name}”有{n_rows}行, 列为: {', '.join(columns)}。"


def summary_chunk(table: DataFrame, name: str, order: list[str], summarise: Callable[[str, list[str], int], str] = plain_summary, at: int = 0, sample: int = 3) -> DataFrame:
    """One row: ``doc_id, sequence, level`` (-1), ``chunk_id_str, content``: a summary, the columns and the first rows in the given order."""
    first = table.orderBy(*order).limit(sample).collect()
    lines = "\n".join(", ".join(f"{c}: {MISSING_CELL if r[c] is None else r[c]}" for c in table.columns) for r in first)
    # The labels of a summary's parts.
    content = f"{summarise(name, table.columns, table.count())}\n\n--- 技术元数据 ---\n来源: 提取自文档'{name}'的第{at + 1}个表格\n表格结构(Schema): {', '.join(table.columns)}\n数据样本:\n{lines}"
    row = [(name, 0, -1, f"{name}_table{at}_summary_0", content)]
    return table.sparkSession.createDataFrame(row, "doc_id string, sequence long, level int, chunk_id_str string, content string")


def table_chunks(table: DataFrame, name: str, order: list[str], use_code_space: bool = True, **options) -> DataFrame:
    """A table for questions that are answered by its SQL is one summary; else each row is a chunk."""
    return summary_chunk(table, name, order, **options) if use_code_space else row_chunks(table, name, order, **options)


def answer_by_sql(question_sql: str, **tables: DataFrame) -> DataFrame:
    """The rows of a question's SQL, in which tables are named in braces; no view is left behind."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(question_sql, **tables)


def cell_sentences(rows: DataFrame) -> DataFrame:
    """``doc_id, sequence, level, chunk_id_str, content`` of rows ``doc_id, table_idx, sequence, cells array<struct<name, value>>`` of many small tables."""
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c["name"], F.lit("是“"), F.coalesce(c["value"], F.lit(MISSING_CELL)), F.lit("”"))), ", ")
    content = F.concat(F.lit("关于“"), F.col("doc_id"), F.lit("”中的一个表格数据记录: "), cells, F.lit("。"))
    key = F.concat(F.col("doc_id"), F.lit("_table"), F.col("table_idx").cast("string"), F.lit("_row_"), F.col("sequence").cast("string"))
    return rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), F.lit(0).alias("level"), key.alias("chunk_id_str"), content.alias("content"))


def cell_summaries(rows: DataFrame, sample: int = 3) -> DataFrame:
    """The same rows as one summary for each table."""
    first = F.array_sort(F.collect_list(F.when(F.col("sequence") < sample, F.struct("sequence", "cells"))))
    by_table = rows.groupBy("doc_id", "table_idx").agg(F.count("*").alias("n"), first.alias("first"))
    names = F.array_join(F.transform(F.col("first")[0]["cells"], lambda c: c["name"]), ", ")
    line = lambda r: F.array_join(F.transform(r["cells"], lambda c: F.concat(c["name"], F.lit(": "), F.coalesce(c["value"], F.lit(MISSING_CELL)))), ", ")
    content = F.concat(
        F.lit("表格“"), F.col("doc_id"), F.lit("”有"), F.col("n").cast("string"), F.lit("行, 列为: "), names, F.lit("。\n\n--- 技术元数据 ---\n来源: 提取自文档'"), F.col("doc_id"),
        F.lit("'的第"), (F.col("table_idx") + 1).cast("string"), F.lit("个表格\n表格结构(Schema): "), names, F.lit("\n数据样本:\n"), F.array_join(F.transform("first", line), "\n"),
    )
    return by_table.select("doc_id", F.lit(0).cast("long").alias("sequence"), F.lit(-1).alias("level"), F.concat(F.col("doc_id"), F.lit("_table"), F.col("table_idx").cast("string"), F.lit("_summary_0")).alias("chunk_id_str"), content.alias("content"))
