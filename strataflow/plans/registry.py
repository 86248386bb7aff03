"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, context, evaluation, exhaustive, graph, index, keyword, lexicon, phrases, retrieval, search, segmentation, tables, tree
from ..sources import files, office
from ..sources.stored import kept, shared_dir, spread
from . import sql as S
from .config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["doc_id", "sequence"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- scalar text functions ---


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '{S.SPACE}', ' ', 'g'))) AS cleaned FROM documents")
def txt_clean(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query(rf"SELECT doc_id, md5(substr(trim(regexp_replace(text, '{S.SPACE}', ' ', 'g')), 1, 1024)) AS input FROM documents")
def txt_embedding_input(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(T.embedding_input(F.col("text"))).alias("input"))


@query("SELECT doc_id, length(text) // 2 AS n_tokens FROM documents")
def txt_token_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT o_orderkey, '关于“orders”中的一个表格数据记录: o_orderkey是“' || o_orderkey || '”, o_orderstatus是“' || o_orderstatus || '”, o_orderpriority是“' || o_orderpriority || '”, missing是“未提供”。' AS sentence FROM orders")
def txt_row_sentence(spark, sf):
    rows = _t(spark, sf, "orders")
    cells = {c: F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")} | {"missing": F.lit(None).cast("string")}
    return rows.select("o_orderkey", T.row_sentence("orders", cells).alias("sentence"))


@query("SELECT conv_id, turn, md5(translate('ＡＢＣ　１２３' || text, 'ＡＢＣ　１２３', 'ABC 123')) AS folded FROM conversations")
def txt_half_width(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.half_width(F.concat(F.lit("ＡＢＣ　１２３"), F.col("text")))).alias("folded"))


@query(
    r"""WITH d AS (SELECT doc_id, text, nullif(length(text), 0) AS n FROM documents)
SELECT doc_id, round(length(regexp_replace(text, '[^`a-zA-Z0-9.,'':;/"?<>!()\-]', '', 'g')) / n, 6) AS english_share,
  coalesce(length(regexp_replace(text, '[^`a-zA-Z0-9.,'':;/"?<>!()\-]', '', 'g')) / n > 0.8, FALSE) AS english, coalesce(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / n > 0.2, FALSE) AS chinese FROM d"""
)
def txt_language(spark, sf):
    t = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", F.round(T.english_share(t), 6).alias("english_share"), T.is_english(t).alias("english"), T.is_chinese(t).alias("chinese"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS n, md5(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|')) AS spans FROM pages")
def txt_extract_between(spark, sf):
    spans = T.extract_between(F.col("html"), "<p>", "</p>")
    return _t(spark, sf, "pages").select("page_id", F.size(spans).cast("long").alias("n"), F.md5(F.array_join(spans, "|")).alias("spans"))


@query(r"SELECT page_id, md5(regexp_replace('<table><tr class=\"x\"><td>' || html, '</?(table|td|caption|tr|th)( [^<>]{0,12})?>', ' ', 'g')) AS stripped FROM pages")
def txt_without_table_tags(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(T.without_table_tags(F.concat(F.lit('<table><tr class="x"><td>'), F.col("html")))).alias("stripped"))


ORACLE_SQL["txt_without_table_tags"] = ORACLE_SQL["txt_without_table_tags"].replace('\\"', '"')


@query(r"SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 100) || '...' AS preview FROM documents")
def txt_preview(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array('1. ' || text, '\n\d*\.?\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '').array_to_string('|') AS lines FROM conversations")
def txt_query_lines(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.query_lines(F.concat(F.lit("1. "), F.col("text"))), "|").alias("lines"))


@query("SELECT doc_id, md5('hash:' || text) AS key FROM documents")
def txt_cache_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.cache_key("hash", F.col("text")).alias("key"))


@query(
    r"""SELECT conv_id, turn, NOT regexp_matches(text, '^第[零一二三四五六七八九十百0-9]+条') AND (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 12
  OR (instr(text, ' ') = 0 AND length(text) >= 32) OR regexp_matches(text, '[,;，。；！!]')) AS not_title, regexp_matches(text, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})') AS not_bullet FROM conversations"""
)
def txt_title_tests(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.not_title(F.col("text")).alias("not_title"), T.not_bullet(F.col("text")).alias("not_bullet"))


# --- chunks ---


def _chunks(spark, sf) -> DataFrame:
    return chunking.chunk_documents(spread(_t(spark, sf, "documents").select("doc_id", "text")))


def _worded(spark, sf) -> DataFrame:
    """Chunks as their words, computed once for several statistics."""
    return kept(_chunks(spark, sf).select(*KEY, T.tokens(F.col("content")).alias("words")))


@query(S.recursive(S.CHUNKS) + " SELECT doc_id, sequence, doc_id || '_text_' || sequence AS chunk_id_str, content FROM chunks")
def chunk_greedy(spark, sf):
    return _chunks(spark, sf)


_FAMILY = " UNION ALL ".join(f"SELECT {i} AS f, '^(?:{'|'.join(p)})' AS pattern" for i, p in enumerate(chunking.BULLETS))


@query(
    rf"""WITH fam AS ({_FAMILY}), lines AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS line FROM documents),
hits AS (SELECT doc_id, f, count(*) FILTER (regexp_matches(line, pattern) AND NOT regexp_matches(line, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{{2,}})')) AS n FROM lines, fam GROUP BY ALL),
best AS (SELECT doc_id, arg_min(f, -n * 10 + f) AS f, max(n) AS n FROM hits GROUP BY doc_id) SELECT doc_id, CASE WHEN n = 0 THEN -1 ELSE f END AS family FROM best"""
)
def chunk_bullet_family(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", chunking.bullet_family(F.split("text", "\n")).alias("family"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents),
levels AS (SELECT doc_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines),
lv AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})') THEN 5 WHEN regexp_matches(s, '^(?:PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN))') THEN 0 WHEN regexp_matches(s, '^(?:Chapter (I+V?|VI*|XI|IX|X))') THEN 1
 WHEN regexp_matches(s, '^(?:Section [0-9]+)') THEN 2 WHEN regexp_matches(s, '^(?:Article [0-9]+)') THEN 3 ELSE 5 END AS level FROM levels)
SELECT doc_id, level, count(*) AS n_lines FROM lv GROUP BY ALL"""
)
def chunk_heading_levels(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", chunking.heading_level(F.col("line"), F.lit(""), 3).alias("level")).groupBy("doc_id", "level").agg(F.count("*").alias("n_lines"))


@query("SELECT o_custkey, (o_orderkey // 10) AS batch, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS content, count(*) AS n_rows FROM orders GROUP BY ALL")
def chunk_row_batches(spark, sf):
    return chunking.batches(_t(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


_ASKED = " ".join(f"WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^(?:{p})') AND NOT regexp_matches(x, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\\.{{2,}})'))) > 0 THEN {i}" for i, p in enumerate(chunking.QUESTIONS))


@query(rf"WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS lines FROM documents) SELECT doc_id, CASE {_ASKED} ELSE -1 END AS pattern FROM l")
def chunk_question_pattern(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", chunking.question_pattern(F.split("text", "\n")).alias("pattern"))


def _levels(spark, sf) -> DataFrame:
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.withColumn("level", chunking.heading_level(F.col("text"), F.lit(""), 3))


@query(
    ORACLE_SQL["chunk_heading_levels"].replace("unnest(regexp_split_to_array(text, '\\n')) AS line", "unnest(regexp_split_to_array(text, '\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\n'), 1) AS place").replace("SELECT doc_id, line, regexp", "SELECT doc_id, place, line, regexp").replace("SELECT doc_id, CASE", "SELECT doc_id, place, CASE").split("SELECT doc_id, level, count(*)")[0]
    + ", c AS (SELECT doc_id, level, count(*) AS n, min(place) AS first FROM lv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level > 4, n DESC, first) AS k FROM c) SELECT doc_id, level FROM r WHERE k = 1"
)
def chunk_frequent_level(spark, sf):
    return chunking.frequent_level(_levels(spark, sf), ["doc_id"], "at", 4)


@query()
def chunk_hierarchical(spark, sf):
    return chunking.hierarchical_merge(_levels(spark, sf))


@query()
def chunk_without_contents(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return chunking.without_contents(lines)


@query(r"SELECT conv_id, turn, CASE WHEN length(b) > 32 THEN substr(s, length(b) + 1) END AS title FROM (SELECT *, regexp_extract(s, '(?s)^(.*(?:[。？！!?;；]|\. ))[^。？！!?;；]*[:：]$', 1) AS b FROM (SELECT conv_id, turn, regexp_replace(string_split(text || ' so it goes:', '@')[1], '^\s+|\s+$', '', 'g') AS s FROM conversations))")
def chunk_colon_titles(spark, sf):
    """Each turn ends with a clause before a colon."""
    return _t(spark, sf, "conversations").select("conv_id", "turn", chunking.colon_title(F.concat("text", F.lit(" so it goes:"))).alias("title"))


@query()
def chunk_question_bullets(spark, sf):
    """Turns as boxes below each other, numbered by place, every third indented."""
    box = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("at"), "text", "role")
    text = F.concat(F.col("at").cast("string"), F.lit(". "), "text")
    return chunking.question_bullets(box.select("doc_id", "at", text.alias("text"), (F.pmod("at", F.lit(3)) * 6.0).alias("x0"), (F.col("at") * 30.0).alias("top"), F.when(F.col("role") == "user", "title").otherwise("text").alias("layout")), 5)


def _as_han(text):
    """Latin letters as Chinese characters, so that the dictionary's ways to split are used."""
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26)))


def _lexicon(spark, sf):
    words = _t(spark, sf, "benchmark").select(F.explode(T.tokens(_as_han(F.col("text")))).alias("term"))
    return lexicon.lexicon(words.groupBy("term").agg(F.count("*").alias("freq")).withColumn("tag", F.lit("n")))


@query(f"WITH w AS (SELECT unnest({S.TOKENS.format('text')}) AS t FROM benchmark) SELECT translate(t, 'abcdefghijklmnopqrstuvwxyz', '{''.join(chr(0x4E00 + i) for i in range(26))}') AS term, trunc(ln(count(*) / 1000000) + 0.5)::INT AS weight, 'n' AS tag FROM w GROUP BY t")
def tok_lexicon(spark, sf):
    return _lexicon(spark, sf)


@query()
def tok_segmented(spark, sf):
    """Conversations without their spaces, split by the words of the benchmark."""
    rows = spread(_t(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.regexp_replace(_as_han(F.col("text")), r"\s+", "").alias("text"))
    return lexicon.segmented(rows, ["conv_id", "turn"], "text", _lexicon(spark, sf)).select("conv_id", "turn", F.array_join("words", " ").alias("words"), F.size("fine_words").alias("n_fine"))


def _number_words(n: int) -> list[str]:
    english = N.in_english(n)
    return [*{" ".join(english), "-".join(english)}, re.sub("^一十", "十", N.in_chinese(n)), *([N.in_roman(n)] if n else [])]


_WORDS = ", ".join(f"('{w}', {n})" for n in range(100) for w in _number_words(n))


@query(f"WITH n(w, v) AS (VALUES {_WORDS}), l AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations), p AS (SELECT conv_id, turn, trim(word) AS word FROM l) SELECT conv_id, turn, sum(greatest(coalesce(try_cast(CASE WHEN regexp_full_match(p.word, '[+-]?[0-9]+') THEN p.word END AS INT), a.v, b.v, -1), 0))::BIGINT AS total FROM p LEFT JOIN n a ON a.w = lower(p.word) LEFT JOIN n b ON b.w = p.word GROUP BY ALL")
def txt_numbers(spark, sf):
    """The sum of the numbers that each turn says, in digits or words."""
    words = _t(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("conv_id", "turn").agg(F.sum(F.greatest(N.number(F.col("word")), F.lit(0))).alias("total"))


# --- tables ---


_ROWS = "SELECT \'orders\' AS doc_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS sequence, 0 AS level, \'关于“orders”中的一个表格数据记录: o_orderkey是“\' || o_orderkey || \'”, o_orderstatus是“\' || o_orderstatus || \'”, o_orderpriority是“\' || coalesce(nullif(o_orderpriority, \'5-LOW\'), \'未提供\') || \'”。\' AS content FROM orders"


@query(f"SELECT *, 'orders_table0_row_' || sequence AS chunk_id_str FROM ({_ROWS})")
def table_row_chunks(spark, sf):
    """Every order as a sentence; the lowest priority counts as missing."""
    rows = _t(spark, sf, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return tables.row_chunks(rows, "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(
    "SELECT 'nation' AS doc_id, 0::BIGINT AS sequence, -1 AS level, 'nation_table0_summary_0' AS chunk_id_str, '表格“nation”有' || count(*) || '行, 列为: n_nationkey, n_name, n_regionkey。' || chr(10) || chr(10) || '--- 技术元数据 ---' || chr(10) || '来源: 提取自文档''nation''的第1个表格' || chr(10) || '表格结构(Schema): n_nationkey, n_name, n_regionkey' || chr(10) || '数据样本:' || chr(10) || "
    "string_agg('n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey, chr(10) ORDER BY n_nationkey) FILTER (n_nationkey < 3) AS content FROM nation"
)
def table_summary_chunk(spark, sf):
    return tables.table_chunks(_t(spark, sf, "nation"), "nation", ["n_nationkey"])


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def table_from_csv(spark, sf):
    """The customers, written as CSV files and read as a table again."""
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    _t(spark, sf, "customer").write.csv(path, header=True, escape='"')
    rows = files.read_table(spark, path)
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT n_name AS doc_id, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS sequence, 0 AS level, n_name || '_table0_row_' || (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1) AS chunk_id_str, '关于“' || n_name || '”中的一个表格数据记录: s_suppkey是“' || s_suppkey || '”, s_name是“' || s_name || '”。' AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def table_files(spark, sf):
    """Suppliers in a CSV file for each nation, which are found by their suffix and become rows of tables."""
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name")
    rows.repartition("n_name").sortWithinPartitions("n_name", "s_suppkey").write.partitionBy("n_name").csv(path, header=True)
    found = files.load_tables(spark, path, doc_id=r"n_name=([^/]*)/[^/]*$")
    return tables.cell_sentences(found)


@query(
    """SELECT 'parts' || (p_partkey // 500) AS doc_id, row_number() OVER (PARTITION BY p_partkey // 500, p_size % 3 ORDER BY p_partkey) - 1 AS sequence,
  '关于“parts' || (p_partkey // 500) || '”中的一个表格数据记录: p_partkey是“' || p_partkey || '”, p_name是“' || p_name || '”, p_brand是“' || CASE WHEN p_partkey % 7 = 0 THEN '未提供' ELSE p_brand END
  || '”, half是“' || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 2)::VARCHAR ELSE (p_partkey // 2) || '.5' END || '”, made是“' || strftime(DATE '2000-01-01' + (p_partkey % 9000)::INT, '%Y-%m-%d 12:00:00') || '”。' AS content FROM part"""
)
def office_workbooks(spark, sf):
    """Parts as workbooks, each with three sheets of texts, numbers, dates and empty cells, which are read back as sentences."""
    made = F.timestamp_seconds(F.unix_seconds(F.lit("2000-01-01 12:00:00").cast("timestamp")) + 86400 * (F.col("p_partkey") % 9000)).alias("made")
    brand = F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("p_brand")
    parts = _t(spark, sf, "part").select((F.floor(F.col("p_partkey") / 500)).alias("book"), (F.col("p_size") % 3).alias("sheet"), "p_partkey", "p_name", brand, (F.col("p_partkey") / 2).alias("half"), made)

    def write(pdf):
        columns = ["p_partkey", "p_name", "p_brand", "half", "made"]
        by_sheet = []
        for i in range(3):
            own = pdf[pdf["sheet"] == i].sort_values("p_partkey")
            by_sheet.append((f"size {i}", [columns, *([int(r.p_partkey), r.p_name, r.p_brand, float(r.half), r.made.to_pydatetime()] for r in own.itertuples())]))
        return pd.DataFrame([(f"parts{pdf['book'].iloc[0]}.xlsx", office.workbook_bytes(by_sheet))], columns=["path", "content"])

    # A workbook has 500 parts.
    books = parts.groupBy("book").applyInPandas(write, "path string, content binary")
    rows = office.workbook_rows(books).select(F.regexp_extract("path", r"(.*)\.", 1).alias("doc_id"), F.col("sheet").alias("table_idx"), "sequence", "cells")
    return tables.cell_sentences(rows).select("doc_id", "sequence", "content")


_PLAIN = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split({_PLAIN}, chr(10))) AS line, generate_subscripts(string_split({_PLAIN}, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, i AS place FROM l WHERE regexp_matches(line, '[^\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]'))
SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (place = 1) AS n_headings, md5(string_agg(replace(line, chr(13), chr(10)), chr(10) || chr(10) ORDER BY i)) AS text FROM p GROUP BY doc_id"""
)
def office_documents(spark, sf):
    """Documents as word processing files, a paragraph for each line, the first line a heading; read back as elements and texts."""

    def write(batches):
        for batch in (whole.slice(at, 50) for whole in batches for at in range(0, whole.num_rows, 50)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            content = [office.document_bytes([("Heading 1" if i == 0 else None, line) for i, line in enumerate((t or "").split("\n"))]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.docx" for i in ids]), pa.array(content, pa.binary())], names=["path", "content"])

    found = kept(office.elements(spread(_t(spark, sf, "documents").select("doc_id", "text")).mapInArrow(write, "path string, content binary")))
    counts = found.groupBy("path").agg(F.count("*").alias("n_paragraphs"), F.count_if(F.col("style") == "Heading 1").alias("n_headings"))
    doc_id = F.regexp_extract("path", r"(.*)\.", 1).cast("long").alias("doc_id")
    return counts.join(office.texts(found), "path").select(doc_id, "n_paragraphs", "n_headings", F.md5("text").alias("text"))


@query(
    rf"""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '[\x00-\x08\x0b-\x0f\x0e-\x1f]', '', 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(html, '[\x00-\x08\x0b-\x0f\x0e-\x1f]', '', 'g'), chr(10)), 1) - 1 AS i FROM pages)
SELECT page_id, i // 5 AS slide, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS elem_idx, md5(line) AS text FROM l WHERE trim(line) <> ''"""
)
def office_slides(spark, sf):
    """Lines of pages as slides of five, read back in order."""

    def write(batches):
        for batch in batches:
            lines = [re.sub(r"[\x00-\x08\x0b-\x0f\x0e-\x1f]", "", t or "").split("\n") for t in batch.column(1).to_pylist()]
            content = [office.slides_bytes([own[i : i + 5] for i in range(0, len(own), 5)]) for own in lines]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.pptx" for i in batch.column(0).to_pylist()]), pa.array(content, pa.binary())], names=["path", "content"])

    found = office.elements(_t(spark, sf, "pages").select("page_id", "html").mapInArrow(write, "path string, content binary"))
    return found.select(F.regexp_extract("path", r"(.*)\.", 1).cast("long").alias("page_id"), F.col("page").cast("long").alias("slide"), F.col("elem_idx").cast("long").alias("elem_idx"), F.md5("text").alias("text"))


_QUESTION = "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


@query("WITH l AS (SELECT l_orderkey, count(*) AS k, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1) SELECT o_orderpriority, sum(k)::BIGINT AS n, round(sum(r), 2) AS revenue FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1")
def table_question(spark, sf):
    """A question's SQL over the tables that it names."""
    return tables.answer_by_sql(_QUESTION, orders=_t(spark, sf, "orders"), lineitem=_t(spark, sf, "lineitem"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def table_summary(spark, sf):
    price = F.col("o_totalprice")
    return _t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.min(price).alias("low"), F.max(price).alias("high"), F.round(F.avg(price), 4).alias("mean"))


# --- tokens, keyword statistics, BM25 ---


def _term_stats(chunks: DataFrame) -> DataFrame:
    """``term, df, idf`` of chunks as words, without postings."""
    return keyword.with_idf(keyword.frequencies(chunks), chunks.agg(F.count("*").cast("double").alias("n")))


@query(f"SELECT doc_id, len({S.TOKENS.format('text')}) AS n_words, md5(array_to_string({S.TOKENS.format('text')}, ' ')) AS words FROM documents")
def tok_words(spark, sf):
    t = T.tokens(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_words"), F.md5(F.array_join(t, " ")).alias("words"))


@query(S.recursive(S.CHUNKS, S.KEYWORDS) + " SELECT doc_id, sequence, term, tf FROM tf")
def kw_postings(spark, sf):
    return keyword.postings(_chunks(spark, sf), KEY)


@query(S.recursive(S.CHUNKS, S.KEYWORDS) + " SELECT term, df, round(idf, 6) AS idf FROM stats")
def kw_term_stats(spark, sf):
    return _term_stats(_worded(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(S.recursive(S.CHUNKS, S.KEYWORDS) + " SELECT count(*) AS n_chunks, sum(dl)::BIGINT AS n_words, round(avg(dl), 6) AS avgdl, max(dl)::BIGINT AS longest FROM lens")
def kw_lengths(spark, sf):
    lens = keyword.doc_lengths(keyword.postings(_chunks(spark, sf), KEY), KEY)
    return lens.agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_words"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


def _query_terms(spark, sf) -> DataFrame:
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return q.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _statistics(chunks: DataFrame, query_terms: DataFrame) -> tuple[DataFrame, float]:
    """``query_id, term, weight`` for the terms that are asked, and the mean length of chunks with terms."""
    weights = query_terms.join(_term_stats(chunks).select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return kept(weights), retrieval.facts_of(chunks).avgdl


@query(S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS, S.BM25) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(kw, 6) DESC, doc_id, sequence) AS rank FROM kw) SELECT query_id, doc_id, sequence, rank, round(kw, 6) AS kw FROM r WHERE rank <= 10")
def kw_bm25_top10(spark, sf):
    chunks = _worded(spark, sf)
    weights, avgdl = _statistics(chunks, _query_terms(spark, sf))
    queries = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("array<double>").alias("embedding"))
    return exhaustive.keyword_top_k(chunks, KEY, queries, weights, avgdl, 10)


@query(
    S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS)
    + ", w AS (SELECT query_id, term, round(qtf * idf, 6) AS weight FROM qtf JOIN stats USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank FROM w) SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS expansion FROM r WHERE rank <= 5 GROUP BY query_id"
)
def qx_keyword_expansion(spark, sf):
    stats = _term_stats(_worded(spark, sf))
    best = keyword.keywords(_query_terms(spark, sf).withColumnRenamed("qtf", "tf"), stats, ["query_id"])
    terms = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return best.groupBy("query_id").agg(F.array_join(F.transform(terms, lambda x: x["term"]), " ").alias("expansion"))


@query("SELECT DISTINCT md5('hash:' || text) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def emb_cache_misses(spark, sf):
    """The texts that have to be embedded where those of labelled documents already are."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    cached = docs.join(_t(spark, sf, "labels"), "doc_id", "left_semi")
    empty = spark.createDataFrame([], "cache_key string, embedding array<double>")
    _, cache = retrieval.encode(cached, empty, "hash", Config().embed_dim)
    return retrieval.encode(docs, cache, "hash", Config().embed_dim)[1].select("cache_key")


@query()
def vec_dense_ids(spark, sf):
    return retrieval.dense_ids(_t(spark, sf, "embeddings").select("vec_id"), ["vec_id"])


@query("SELECT count(*) AS n, count(*) AS n_different, 100 AS low, 100 + count(*) - 1 AS high FROM orders")
def dense_ids_span(spark, sf):
    """Orders numbered from 100 on, in several buckets: no number is left out and none repeats."""
    ids = retrieval.dense_ids(_t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], start=100, buckets=50)
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_different"), F.min("id").alias("low"), F.max("id").alias("high"))


# --- vectors ---

_PAIRS = "SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"
_TOP = f"WITH p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) "


def _vector_queries(spark, sf) -> tuple[DataFrame, DataFrame]:
    vectors = _t(spark, sf, "embeddings")
    return vectors, vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(_TOP + "SELECT query_id, vec_id, rank, s AS score FROM r WHERE rank <= 25")
def vec_exact_cosine(spark, sf):
    vectors, queries = _vector_queries(spark, sf)
    return search.exact_top_k(vectors, ["vec_id"], queries, 25)


@query(_TOP + "SELECT query_id, vec_id, rank, round(1 / (1 + sqrt(greatest(0, 2 - 2 * s)) + 1e-6), 6) AS score FROM r WHERE rank <= 25")
def vec_exact_l2(spark, sf):
    vectors, queries = _vector_queries(spark, sf)
    return search.exact_top_k(vectors, ["vec_id"], queries, 25).withColumn("score", F.round(V.l2_score(F.col("score")), 6))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dim FROM embeddings")
def vec_norms(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
def vec_stats(spark, sf):
    return _t(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query(
    "WITH p AS (SELECT v.vec_id, q.label, sum(0) OVER () AS z, v.embedding AS e, q.embedding AS qe FROM embeddings v JOIN embeddings q ON v.label = q.label AND q.vec_id % 50 = 0), s AS (SELECT vec_id, label, round(max(list_inner_product(e::DOUBLE[], qe::DOUBLE[])), 6) AS best FROM p GROUP BY ALL) SELECT vec_id, label, best FROM s"
)
def vec_best_in_label(spark, sf):
    """For each row the best dot product with a query of its label; the queries go through in blocks, without a join."""
    vectors, _ = _vector_queries(spark, sf)
    q = vectors.where(F.col("vec_id") % 50 == 0).select("label", "embedding")
    return search.best_dot(vectors.select("vec_id", "label", "embedding"), ["vec_id", "label"], q, "label").withColumn("best", F.round("best", 6))


@query()
def vec_cells(spark, sf):
    """Cell-partitioned search of all rows; the recall against exact search is tested."""
    vectors, queries = _vector_queries(spark, sf)
    n = max(1, int(vectors.count() ** 0.5))
    centres = index.fit_cells(vectors, n)
    return index.search_cells(index.assign_cells(vectors, ["vec_id"], centres), ["vec_id"], index.assign_cells(queries, ["query_id"], centres, probes=max(1, 3 * n // 4)), 5)


# --- fusion and hybrid search ---


@query(
    _TOP
    + ", l AS (SELECT query_id, vec_id, 0 AS sub, rank, s FROM r WHERE rank <= 25 UNION ALL SELECT query_id, vec_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY vec_id), s FROM r WHERE rank <= 50), f AS (SELECT query_id, vec_id, sum(1 / (60.0 + rank)) AS rrf, arg_min(s, sub * 1000 + rank) AS v FROM l GROUP BY ALL) SELECT query_id, vec_id, round(rrf, 9) AS rrf, v AS vec_score FROM f"
)
def rank_fusion(spark, sf):
    vectors, queries = _vector_queries(spark, sf)
    top = search.exact_top_k(vectors, ["vec_id"], queries, 50)
    by_id = F.row_number().over(W.partitionBy("query_id").orderBy("vec_id"))
    lists = top.where("rank <= 25").withColumn("sub_idx", F.lit(0)).unionByName(top.withColumn("rank", by_id).withColumn("sub_idx", F.lit(1)))
    return search.fuse(lists, ["vec_id"]).select("query_id", "vec_id", F.round("rrf", 9).alias("rrf"), "vec_score")


ORACLE_SQL["rank_fusion"] = ORACLE_SQL["rank_fusion"].replace("FROM p) , l", "FROM p), l")


def _index(spark, sf, config: Config, rerank: bool = True) -> retrieval.Index:
    """An index of the chunks for one search: with keywords where it reranks by them."""
    return retrieval.index_of(_chunks(spark, sf).select(*KEY, "content"), KEY, config.embed_dim, with_text=False, with_keywords=rerank and config.kw_weight != 0)


def _items(spark, sf) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _rounded(results: DataFrame) -> DataFrame:
    """Scores by vectors have 9 digits and stay as they are: to round them again would split hairs at the halves."""
    return results.select("query_id", *KEY, "rank", "score", "vec_score", F.round("kw_score", 6).alias("kw_score"))


def _hybrid(spark, sf, config: Config) -> DataFrame:
    """Results of all benchmark items: candidates by vector, rescored by keywords."""
    return retrieval.hybrid_search(_index(spark, sf, config), retrieval.sub_queries(_items(spark, sf)), config)


_SEARCH_SQL = S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS, S.BM25, S.SEARCH, S.RERANK("hits", "found"))


@query(_SEARCH_SQL + " SELECT query_id, doc_id, sequence, rank, score, vec AS vec_score, round(kws, 6) AS kw_score FROM found")
def hybrid_search(spark, sf):
    return _rounded(_hybrid(spark, sf, Config()))


_FOUND_SQL = " SELECT query_id, doc_id, sequence, rank, score, vec AS vec_score, round(kws, 6) AS kw_score FROM found"


@query(S.recursive(S.chunks_of("doc_id % 7 <> 0"), S.KEYWORDS, S.QUERY_TERMS, S.BM25, S.SEARCH, S.RERANK("hits", "found")) + _FOUND_SQL)
def index_grown(spark, sf):
    """An index that is built from a half of the documents, gets the rest and then loses every seventh, searched for all items."""
    from ..engine import Engine

    docs, engine = _t(spark, sf, "documents").select("doc_id", "text"), Engine(spark, f"{shared_dir(spark).rstrip('/')}/indexes-{uuid.uuid4().hex}")
    engine.build("grown", docs.where("doc_id % 2 = 0"), Config(index_type="Flat"))
    engine.append("grown", docs.where("doc_id % 2 = 1"))
    engine.remove("grown", docs.where("doc_id % 7 = 0"))
    return _rounded(engine.search("grown", _items(spark, sf)))


@query(S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS, S.BM25, S.search_among("doc_id % 3 = 0 AND sequence > 1"), S.RERANK("hits", "found")) + _FOUND_SQL)
def search_filtered(spark, sf):
    """Results among some documents' further chunks only: the best of these, with the statistics of all."""
    index = _index(spark, sf, Config()).where((F.col("doc_id") % 3 == 0) & (F.col("sequence") > 1))
    return _rounded(retrieval.hybrid_search(index, retrieval.sub_queries(_items(spark, sf)), Config()))


@query()
def vec_graph(spark, sf):
    """The best 10 by neighbour graphs for every fiftieth vector, with how many of them an exact search finds, too."""
    vectors = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    config = Config()
    found = graph.search_graphs(kept(graph.graphs(vectors, ["vec_id"], config.hnsw_m, config.hnsw_ef_con)), ["vec_id"], queries, 10, config.hnsw_ef)
    exact = search.exact_top_k(vectors, ["vec_id"], queries, 10).select("query_id", "vec_id", F.lit(True).alias("exact"))
    return found.join(exact, ["query_id", "vec_id"], "left").select("query_id", "vec_id", "rank", "score", F.coalesce("exact", F.lit(False)).alias("exact"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS word FROM conversations),
w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE word <> '')
SELECT conv_id, turn, md5(coalesce(string_agg(CASE WHEN w.word IS NOT NULL THEN length(w.word)::VARCHAR ELSE c.word END, ' ' ORDER BY i), '')) AS converted FROM c LEFT JOIN w USING (word) GROUP BY conv_id, turn"""
)
def txt_phrases(spark, sf):
    """Words of the benchmark in conversations become their lengths: phrases with the spaces around them, longer than any other that begins there."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    mapping = words.select(F.concat(F.lit("\x1f"), "w", F.lit("\x1f")).alias("source"), F.concat(F.lit("\x1f"), F.length("w").cast("string"), F.lit("\x1f")).alias("target"))
    bounded = F.concat(F.lit("\x1f"), F.replace("text", F.lit(" "), F.lit("\x1f \x1f")), F.lit("\x1f"))
    converted = phrases.converter(mapping)(bounded)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.replace(converted, F.lit("\x1f"), F.lit(""))).alias("converted"))


@query()
def tok_stems(spark, sf):
    """How many words of the documents have each English stem."""
    words = _t(spark, sf, "documents").select(F.explode(segmentation.stemmed(T.tokens)(F.col("text"))).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("n"))


@query(
    S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS, S.SUB_QUERIES, S.RERANK("hits", "found"))
    + " SELECT query_id, doc_id, sequence, rank, score, vec AS vec_score, round(kws, 6) AS kw_score FROM found"
)
def hybrid_search_expanded(spark, sf):
    """Each item and its five keywords as two sub-queries, whose lists are fused."""
    index = _index(spark, sf, Config())
    return _rounded(retrieval.hybrid_search(index, retrieval.sub_queries(_items(spark, sf), index.term_stats), Config()))


@query(_SEARCH_SQL + ", v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, r) AS rank FROM hits WHERE vec >= 0.6) SELECT query_id, doc_id, sequence, rank, vec AS score, vec AS vec_score, NULL::DOUBLE AS kw_score FROM v WHERE rank <= 5")
def search_vector_only(spark, sf):
    return _rounded(_hybrid(spark, sf, Config(vec_weight=1.0, kw_weight=0.0)))


@query(_SEARCH_SQL + " SELECT query_id, doc_id, sequence, r AS rank, 1 / (60.0 + r) AS score, vec AS vec_score, NULL::DOUBLE AS kw_score FROM hits WHERE 1 / (60.0 + r) >= 0.016 AND r <= 5")
def search_fused_threshold(spark, sf):
    """Without a weight on keywords, as a chain of fusion and reranking has it: the threshold is held against the fused score."""
    config = Config(vec_weight=1.0, kw_weight=0.0, threshold=0.016)
    return _rounded(retrieval.hybrid_search(_index(spark, sf, config), retrieval.sub_queries(_items(spark, sf)), config, parity=True))


_L2_SQL = _SEARCH_SQL.replace("FROM hits h LEFT JOIN kw", "FROM (SELECT * REPLACE (round(1 / (1 + sqrt(greatest(0, 2 - 2 * vec)) + 1e-6), 9) AS vec) FROM hits) h LEFT JOIN kw").replace("WHERE score >= 0.6", "WHERE score >= 0.4")


@query(_L2_SQL + " SELECT query_id, doc_id, sequence, rank, score, vec AS vec_score, round(kws, 6) AS kw_score FROM found")
def hybrid_search_l2(spark, sf):
    """Scores by Euclidean distance, with a threshold on their scale."""
    return _rounded(_hybrid(spark, sf, Config(metric="l2", threshold=0.4)))


@query(_SEARCH_SQL + " SELECT query_id, doc_id, sequence, r AS rank, round(1 / (60.0 + r), 12) AS score, vec AS vec_score, NULL::DOUBLE AS kw_score FROM hits")
def search_without_rerank(spark, sf):
    config = Config()
    found = retrieval.hybrid_search(_index(spark, sf, config, rerank=False), retrieval.sub_queries(_items(spark, sf)), config, use_rerank=False)
    return _rounded(found.withColumn("score", F.round("score", 12)))


@query(_SEARCH_SQL + " SELECT query_id, count(*) AS total, max(score) AS max_score, min(score) AS min_score, round(avg(score), 6) AS avg_score FROM found GROUP BY query_id")
def search_statistics(spark, sf):
    stats = search.search_stats(_hybrid(spark, sf, Config()))
    return stats.select("query_id", "total", "max_score", "min_score", F.round("avg_score", 6).alias("avg_score"))


# --- context and reports ---


@query(
    S.recursive(S.CHUNKS)
    + ", n AS (SELECT doc_id, sequence, row_number() OVER (PARTITION BY doc_id ORDER BY sequence) AS rn FROM chunks) SELECT a.doc_id, a.sequence, count(*) AS n_context, string_agg(b.sequence::VARCHAR, ',' ORDER BY b.sequence) AS context FROM n a JOIN n b ON a.doc_id = b.doc_id AND abs(a.rn - b.rn) <= 2 GROUP BY ALL"
)
def context_window(spark, sf):
    return context.context_windows(_chunks(spark, sf))


@query(S.recursive(S.CHUNKS) + " SELECT c.doc_id, c.sequence, md5(content) AS content FROM chunks c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 0) AND sequence BETWEEN 1 AND 3")
def context_neighbours(spark, sf):
    chosen = _t(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(2).alias("at"))
    return context.neighbours(_chunks(spark, sf), chosen).select("doc_id", "sequence", F.md5("content").alias("content"))


@query(
    S.recursive(S.CHUNKS)
    + " SELECT doc_id, count(*) AS n_chunks, md5(chr(10) || '## 文档: ' || doc_id || chr(10) || chr(10) || string_agg('### 块 - 整数ID: `' || sequence || '` | 字符串ID: `' || doc_id || '_text_' || sequence || '`' || chr(10) || '- **来源:** 原始文档 (文本分块)' || chr(10) || '- **内容:**' || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) ORDER BY sequence)) AS section FROM chunks GROUP BY doc_id"
)
def document_report(spark, sf):
    rows = _chunks(spark, sf).withColumns({"level": F.lit(0), "children": F.lit(None).cast("array<string>"), "chunking_strategy": F.lit("intelligent_naive_merge"), "element_type": F.lit(None).cast("string")})
    sections = context.report_sections(rows.withColumn("origin", context.origin()))
    return sections.withColumn("section", F.md5("section"))


_SIMILAR = _TOP + ", o AS (SELECT * FROM r WHERE rank <= 6 AND vec_id <> query_id), k AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM o) SELECT query_id, vec_id, rank, s AS score FROM k WHERE rank <= 5"


@query(_SIMILAR.replace("FROM p) , o", "FROM p), o"))
def more_like_this(spark, sf):
    """The five rows most like each query, itself left out."""
    vectors, queries = _vector_queries(spark, sf)
    return search.more_like(vectors, "vec_id", queries.select(F.col("query_id").alias("vec_id")), 5)


# --- evaluation ---


@query(
    S.recursive(S.CHUNKS, S.KEYWORDS, S.QUERY_TERMS, S.BM25, S.SEARCH, S.RERANK("hits", "found"), S.RERANK("ranked", "ideal"))
    + """, a AS (SELECT query_id, count(*) AS n, sum(score) AS s FROM found GROUP BY 1), i AS (SELECT query_id, count(*) AS n, sum(score) AS s FROM ideal GROUP BY 1),
b AS (SELECT f.query_id, count(*) AS n FROM found f JOIN ideal USING (query_id, doc_id, sequence) GROUP BY 1)
SELECT q.query_id, coalesce(a.n, 0) AS retrieved, coalesce(i.n, 0) AS ideal, round(CASE WHEN coalesce(i.n, 0) = 0 THEN 1.0 ELSE coalesce(b.n, 0) / i.n END, 6) AS precision_recall,
round(CASE WHEN coalesce(i.s, 0) = 0 THEN (CASE WHEN coalesce(a.s, 0) = 0 THEN 1.0 ELSE 0.0 END) ELSE coalesce(a.s, 0) / i.s END, 6) AS relevance_recall FROM queries q LEFT JOIN a USING (query_id) LEFT JOIN i USING (query_id) LEFT JOIN b USING (query_id)"""
)
def evaluation_recalls(spark, sf):
    """The live search against the ideal one, which ranks every chunk."""
    return _recalls(spark, sf)


def _recalls(spark, sf) -> DataFrame:
    index, items = _index(spark, sf, Config()), _items(spark, sf)
    found, ideal = retrieval.hybrid_search(index, retrieval.sub_queries(items), Config()), retrieval.ideal_search(index, items, Config())
    return evaluation.recalls(found, ideal, items.select("query_id"), KEY)


@query(ORACLE_SQL["evaluation_recalls"].replace("SELECT q.query_id, coalesce", "SELECT 'default' AS mode, count(*) AS n_queries, round(avg(precision_recall), 6) AS mean_precision, round(avg(relevance_recall), 6) AS mean_relevance, sum(retrieved)::BIGINT AS retrieved FROM (SELECT q.query_id, coalesce") + ")")
def evaluation_batch(spark, sf):
    return evaluation.batch_means(_recalls(spark, sf).withColumn("mode", F.lit("default")))


# --- sources and trees ---


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<h1>')) AS n_h1, length(html) AS n_chars FROM pages"""
)
def page_tags(spark, sf):
    n = lambda tag: F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).cast("long")
    return _t(spark, sf, "pages").select("page_id", n("<p>").alias("n_p"), n("<h1>").alias("n_h1"), F.length("html").cast("long").alias("n_chars"))


_BLOCKS = r"</?(p|h[1-6]|li|div|title|blockquote|pre)(\s[^>]*)?>"


@query(
    rf"""WITH plain AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS html FROM pages),
b AS (SELECT page_id, unnest(regexp_split_to_array(html, '(?i){_BLOCKS}')) AS block, generate_subscripts(regexp_split_to_array(html, '(?i){_BLOCKS}'), 1) AS i FROM plain),
t AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '{S.SPACE}', ' ', 'g')) AS text FROM b)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS elem_idx, 'text' AS kind, text FROM t WHERE text <> ''"""
)
def page_elements(spark, sf):
    return files.page_elements(_t(spark, sf, "pages"))


@query(
    """WITH c AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_idx, n_nationkey, n_name FROM nation)
SELECT n_regionkey AS page_id, row_idx, 'key' AS "column", n_nationkey::VARCHAR AS value FROM c UNION ALL SELECT n_regionkey, row_idx, 'the name', n_name || ' & more' FROM c"""
)
def page_tables(spark, sf):
    """A page with a table of its nations for each region, whose cells are read back."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("n_nationkey").cast("string")), cell(F.concat(F.col("n_name"), F.lit(" &amp;\n more"))), F.lit("</tr>"))
    rows = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("x"))
    html = F.concat(F.lit("<p>Nations</p><table><tr><th>key</th><th>the <b>name</b></th></tr>"), F.array_join(F.col("x")["row"], ""), F.lit("</table><p>end"))
    found = files.table_rows(files.page_elements(rows.select(F.col("n_regionkey").alias("page_id"), html.alias("html"))))
    return found.select("page_id", F.col("row_idx").cast("long").alias("row_idx"), "column", "value")


@query()
def summary_tree(spark, sf):
    return tree.summary_tree(_chunks(spark, sf))


@query(S.recursive(S.CHUNKS) + " SELECT doc_id, count(*) FILTER (sequence = 1) AS first_chunks, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY doc_id")
def chunk_census(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count_if(F.col("sequence") == 1).alias("first_chunks"), F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
