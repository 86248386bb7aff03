"""The library's operators against plain Python and, through DuckDB, their SQL."""

import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.engine import NOTHING_FOUND, Engine
from strataflow.functions import numbers
from strataflow.functions import text as T
from strataflow.operators import chunking, context, evaluation, exhaustive, index, keyword, lexicon, retrieval, search, tree
from strataflow.plans import registry
from strataflow.plans.config import Config, update_plan
from strataflow.plans.registry import ORACLE_SQL, QUERIES
from strataflow.sources import files
from strataflow.sources.store import IndexStore
from strataflow.sources.stored import kept
from strataflow.streaming import updates

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "size", "want"), [("甲甲。乙乙；丙丙", 0, ["甲甲", "乙乙", "丙丙"]), ("a" * 400 + "\n" + "b" * 400 + "\n" + "c" * 20, 256, ["a" * 400 + "b" * 400, "c" * 20]), ("no delimiters", 256, ["no delimiters"]), ("", 256, [""]), ("a" * 600 + "\n\n" + "b", 256, ["a" * 600, "", "b"])])
def test_greedy_merge(spark, text, size, want):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["sequence"]: r["content"] for r in chunking.chunk_documents(docs, size).collect()}
    assert got == {i: c for i, c in enumerate(want, 1) if c.strip()}


def test_a_long_text_in_chunks(spark):
    """In time that grows with its length."""
    text = "\n".join(f"line {i} of a text" for i in range(300_000))
    chunks = chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert chunks.agg(F.sum(F.length("content"))).first()[0] == len(text.replace("\n", "")) and chunks.count() > 5000


def test_text_functions(spark):
    assert one(spark, T.half_width(F.col("t")), t="ＡＢＣ　１２３") == "ABC 123"
    assert one(spark, T.clean(F.col("t")), t=" a\x00\x07b　\n c ") == "ab c"
    assert one(spark, T.query_lines(F.col("t")), t="1. one\n2. two\n3.three\n\n") == ["1. one", "two", "three"]
    assert one(spark, T.is_english(F.col("t")), t="") is False
    assert [one(spark, T.items_are_english(F.array(*map(F.lit, x)))) for x in (["a", "b", "1", "?", " c "], ["ab", "b"], ["中", "a"])] == [True, False, False]
    assert T.delimiter_regex("\n`###`!") == r"\#\#\#|" + "\n" + r"|\!"


def test_ranking(spark):
    hits = spark.createDataFrame([(1, s, c, r, 1.0 - r / 10) for s, order in enumerate([[1, 2], [2, 1]]) for r, c in enumerate(order, 1)], "query_id long, sub_idx int, c long, rank int, score double")
    got = {r["c"]: r for r in search.fuse(hits, ["c"]).collect()}
    assert got[1]["rrf"] == pytest.approx(1 / 61 + 1 / 62) == got[2]["rrf"] and tuple(got[1]["seen"]) < tuple(got[2]["seen"])
    flat = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4)], "query_id long, c long, kw double")
    best = search.rerank(search.fuse(hits, ["c"]), flat, ["c"], 0.8, 0.2, 0.72, 2).collect()
    assert [(r["c"], r["rank"], r["kw_score"]) for r in best] == [(1, 1, 0.0)]


def test_exact_search_in_blocks(spark, monkeypatch):
    m = np.random.default_rng(0).normal(size=(300, 8))
    m[7] = m[3]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: sorted(range(300), key=lambda j, i=i: (-round(float(unit[i] @ unit[j]), 9), j))[:5] for i in range(20)}
    for size in (8 << 20, 300):
        monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", size)
        got = {}
        for r in search.exact_top_k(v, ["vec_id"], q, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want
    assert search.exact_top_k(v, ["vec_id"], q.limit(0), 5).count() == 0


def test_more_like(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "k long, embedding array<double>")
    got = search.more_like(v, "k", spark.createDataFrame([(1,), (9,)], "k long"), 1).collect()
    assert [(r["query_id"], r["k"], r["rank"]) for r in got] == [(1, 2, 1)]


def test_cells_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in search.exact_top_k(v, ["vec_id"], q, 5).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in QUERIES["vec_cells"](spark, "/root/testdata/sf0.01").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    centres = index.fit_cells(v, 10)
    all_cells = index.search_cells(index.assign_cells(v, ["vec_id"], centres), ["vec_id"], index.assign_cells(q, ["query_id"], centres, probes=10), 5)
    assert {(r["query_id"], r["vec_id"]) for r in all_cells.collect()} == exact


def test_bm25(spark):
    texts = ["a b a c", "b b d", "a", "e f g h"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "c long, content string")
    posts = keyword.postings(chunks, ["c"])
    lens = keyword.doc_lengths(posts, ["c"])
    stats = keyword.term_stats(posts, chunks.agg(F.count("*").cast("double").alias("n")))
    q = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (0, "zz", 1)], "query_id long, term string, qtf long")
    got = {r["c"]: r["kw"] for r in keyword.bm25(posts.select(F.lit(0).cast("long").alias("query_id"), "c").distinct(), posts, stats, lens, q, ["c"], lens.agg(F.avg("dl").alias("avgdl"))).collect()}
    words = [t.split() for t in texts]
    n, df = len(words), Counter(w for t in words for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean, avg = sum(raw.values()) / len(raw), sum(map(len, words)) / n
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    for i, t in enumerate(words):
        want = sum(k * idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, k in (("a", 2), ("b", 1)))
        assert got.get(i, 0.0) == pytest.approx(want)


def test_recalls(spark):
    schema = "query_id long, c long, score double"
    actual, ideal = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 5, 0.7)], schema), spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.8)], schema)
    got = {r["query_id"]: (r["precision_recall"], r["relevance_recall"]) for r in evaluation.recalls(actual, ideal, spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), ["c"]).collect()}
    assert got == {1: (0.5, 1.0), 2: (1.0, 0.0), 3: (1.0, 1.0)}


def test_trees(spark):
    chunks = spark.createDataFrame([(1, 1, "only")] + [(2, i, f"t{i} same words") for i in range(2)] + [(3, i, f"{'red blue' if i % 2 else 'cat dog'} {i}") for i in range(8)], "doc_id long, sequence int, content string")
    got = tree.summary_tree(chunks).collect()
    assert max(r["level"] for r in got if r["doc_id"] == 1) == 0
    assert [(r["level"], sorted(r["children"])) for r in got if r["doc_id"] == 2 and r["level"]] == [(1, ["2_text_0", "2_text_1"])]
    assert sum(len(r["children"]) for r in got if r["doc_id"] == 3 and r["level"] == 1) == 8


def test_tree_of_a_long_document(spark):
    chunks = spark.createDataFrame([(1, i, f"{'red blue' if i % 2 else 'cat dog'} {i % 7}") for i in range(60)] + [(2, 0, "one"), (2, 1, "two")], "doc_id long, sequence int, content string")
    got = tree.summary_tree(chunks, part=16, max_clusters=3).collect()
    for doc in (1, 2):
        own = [r for r in got if r["doc_id"] == doc]
        top = max(r["level"] for r in own)
        assert sum(r["level"] == top for r in own) == 1 and len({r["node"] for r in own}) == len(own)
        below = [c for r in own for c in r["children"]]
        assert sorted(below) == sorted(r["node"] for r in own if r["level"] < top)


def test_report(spark, tmp_path):
    rows_ = [(2, 0, 1, "2_text_1", "x", "o", None), (1, 1, -1, "1_level1_node0", "sum", "LLM 生成 (RAPTOR 摘要)", ["1_text_1"]), (1, 0, 1, "1_text_1", "first", "o", [])]
    sections = context.report_sections(spark.createDataFrame(rows_, "doc_id long, level int, sequence int, chunk_id_str string, content string, origin string, children array<string>"))
    context.write_report(sections, str(tmp_path / "r"), "m")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r"), wholetext=True).orderBy(F.input_file_name()).collect())
    assert text.index("总块数:** 3") < text.index("## 文档: 1\n") < text.index("`1_text_1`\n- **来源:** o") < text.index("- **参考块:** `1_text_1`") < text.index("## 文档: 2\n")


def test_pages_and_files(spark, tmp_path):
    html = "<h1>Top</h1><p>a <b>b</b></p><script>x</script><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>two</td></tr></table><p>end"
    elements = files.page_elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert [(r["kind"], r["text"]) for r in elements.orderBy("elem_idx").collect()] == [("text", "Top"), ("text", "a b"), ("table", "k\tv\n1\ttwo"), ("text", "end")]
    assert [(r["column"], r["value"]) for r in files.table_rows(elements).collect()] == [("k", "1"), ("v", "two")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("héllo \n wörld".encode())
    (tmp_path / "sub/b.md").write_bytes("你好".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 \x00")
    (tmp_path / "t.csv").write_text('k,"v, w"\n1,"x ""y"""\n2,\n3,z,extra\n')
    (tmp_path / "u.csv").write_text("other\n\n5\n")
    assert {r["doc_id"]: r["text"] for r in files.load_documents(spark, str(tmp_path)).collect()} == {"a": "héllo wörld", "b": "你好"}
    assert {r["path"].split("/")[-1]: r["reason"] for r in files.left_out(spark, str(tmp_path)).collect()} == {"c.bin": "unknown suffix", "d.pdf": "its format needs a parser"}
    cells = {(r["doc_id"], r["sequence"]): [(c["name"], c["value"]) for c in r["cells"]] for r in files.load_tables(spark, str(tmp_path)).collect()}
    assert cells == {("t", 0): [("k", "1"), ("v, w", 'x "y"')], ("t", 1): [("k", "2"), ("v, w", None)], ("t", 2): [("k", "3"), ("v, w", "z")], ("u", 0): [("other", "5")]}
    rows_ = {r["chunk_id_str"]: r["content"] for r in files.file_chunks(spark, str(tmp_path), use_code_space=False).collect()}
    assert rows_.keys() == {"a_text_1", "b_text_1", "t_table0_row_0", "t_table0_row_1", "t_table0_row_2", "u_table0_row_0"} and rows_["t_table0_row_1"] == "关于“t”中的一个表格数据记录: k是“2”, v, w是“未提供”。"
    whole = {r["chunk_id_str"]: (r["level"], r["content"]) for r in files.file_chunks(spark, str(tmp_path)).collect()}
    assert whole["u_table0_summary_0"] == (-1, "表格“u”有1行, 列为: other。\n\n--- 技术元数据 ---\n来源: 提取自文档'u'的第1个表格\n表格结构(Schema): other\n数据样本:\nother: 5")
    ragged = spark.createDataFrame([(1, 0, "table", "a\tb\n1\n2\t3\t4")], "page_id long, elem_idx int, kind string, text string")
    assert [(r["row_idx"], r["column"], r["value"]) for r in files.table_rows(ragged).collect()] == [(0, "a", "1"), (0, "b", None), (1, "a", "2"), (1, "b", "3"), (1, "column2", "4")]


def test_store_and_config(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.state("none")
    assert store.list().count() == 0 and not store.delete("none")
    part = store.write("one", {"chunks": spark.range(3).withColumnRenamed("id", "doc_id")})
    state = {"segments": [{"part": part, "order": 1}], "removed": [], "stats": part}
    assert store.commit("one", 0, state) == 1
    store.register("one", metric="cosine")
    assert store.live("one", state, "chunks").count() == 3 and store.list().first()["name"] == "one" and store.state("one") == (1, state)
    c = Config()
    with pytest.warns(UserWarning, match="unknown"):
        assert Config.from_json(c.to_json()[:-2] + ', "unknown": 1}') == c
    blueprint = Config.from_json('{"mode_name": "m", "proc_chunk_token_size": 200, "proc_enable_raptor": true, "proc_raptor_max_clusters": 12, "use_code_space": false, "hnsw_m": 32, "llm_model_name": "x"}')
    assert (blueprint.proc_chunk_token_size, blueprint.proc_enable_raptor, blueprint.proc_raptor_max_clusters) == (200, True, 12)
    assert update_plan(c, c.updated(top_k=9)) == "hot" and update_plan(c, c.updated(proc_chunk_token_size=9)) == "rebuild" and update_plan(c, c.updated(metric="l2")) == "hot" and update_plan(None, c) == "rebuild"
    with pytest.raises(ValueError):
        Config(vec_weight=0.9)


def test_context(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}") for i in (1, 2, 4, 5, 6)], "doc_id long, sequence int, content string")
    assert context.neighbours(chunks, spark.createDataFrame([(1, 5)], "doc_id long, at int")).count() == 3
    assert context.by_position(chunks, doc_id=1, sequence=4).first()["content"] == "c4"
    results = spark.createDataFrame([(7, 1, 4, 0.5), (7, 1, 1, 0.4), (8, 2, 1, 0.3)], "query_id long, doc_id long, sequence int, score double")
    assert {(r["query_id"], r["sequence"]): r["context"] for r in context.with_context(results, chunks).collect()} == {(7, 4): "c4\nc5", (7, 1): "c1\nc2", (8, 1): None}


def test_exhaustive_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None if i == 5 else [] if i == 6 else [f"w{w}" for w in rng.integers(0, 12, rng.integers(1, 9))] for i in range(700)]
    vectors = [None if i == 9 else v.tolist() for i, v in enumerate(np.abs(rng.normal(size=(700, 4))))]
    chunks = spark.createDataFrame(list(zip(range(700), texts, vectors, strict=True)), "c long, words array<string>, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, vectors[i]) for i in range(8)] + [(8, [0.0] * 4)], "query_id long, embedding array<double>")
    asked = {i: {f"w{i}": 0.5, f"w{i + 3}": 1.5} for i in range(8)}
    weights = spark.createDataFrame([(i, t, w) for i, own in asked.items() for t, w in own.items()] + [(99, "w1", 1.0)], "query_id long, term string, weight double")
    avg = 4.0
    raw = {(i, j): sum(w * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x, w in asked.get(i, {}).items()) for i in range(9) for j, t in enumerate(t or [] for t in texts)}
    unit = [np.zeros(4) if v is None else np.array(v) / np.linalg.norm(v) for v in vectors]
    qunit = [*unit[:8], np.zeros(4)]
    words, both = {}, {}
    for i in range(9):
        matched = [j for j in range(700) if set(texts[j] or []) & set(asked.get(i, {}))]
        words[i] = sorted(matched, key=lambda j, i=i: (-round(raw[i, j], 6), j))[:4]
        span = max(raw[i, j] for j in range(700))
        score = {j: round(round(float(qunit[i] @ unit[j]), 9) * 0.8 + (raw[i, j] / span if span else 0) * 0.2, 9) for j in range(700)}
        both[i] = sorted((j for j in score if score[j] >= 0.6), key=lambda j, i=i, score=score: (-score[j], -round(float(qunit[i] @ unit[j]), 9), j))[:4]

    def found(df):
        out = {i: [] for i in range(9)}
        for r in df.orderBy("query_id", "rank").collect():
            out[r["query_id"]].append(r["c"])
        return out

    for size in (32 << 20, 100):
        monkeypatch.setattr(exhaustive, "BLOCK_BYTES", size)
        assert found(exhaustive.keyword_top_k(chunks, ["c"], q, weights, avg, 4)) == words
        assert found(exhaustive.hybrid_top_k(chunks, ["c"], q, weights, avg, 0.8, 0.2, 0.6, 4)) == both
    assert exhaustive.hybrid_top_k(chunks, ["c"], q.limit(0), weights, avg, 0.8, 0.2, 0.6, 4).count() == 0
    assert exhaustive.keyword_top_k(chunks.limit(0), ["c"], q, weights, avg, 4).count() == 0


def test_more_text_functions(spark):
    words = {"7": 7, " 12 ": 12, "seven": 7, "七": 7, "VII": 7, "ninety-nine": 99, "二十一": 21, "xyz": -1, "": -1}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["n"] for r in df.select("w", numbers.number(F.col("w")).alias("n")).collect()} == words
    assert [one(spark, T.char_class(F.col("c")), c=c) for c in "中5x?"] == ["chinese", "digit", "letter", None]
    assert one(spark, T.spaced_words(F.array(*map(F.lit, ["ab", "cd", "中", "e"])))) == ["ab", " ", "cd", "中", "e"]
    assert one(spark, T.language_runs(F.col("t")), t="hello 中文abc, x") == ["hello", "中文", "abc", "x"]
    assert len(one(spark, T.random_choices(F.array(*map(F.lit, range(9))), 4))) == 4


def test_more_chunking(spark):
    parts = spark.createDataFrame([(1, [("aa\nbb", "i1", "@@1"), ("c" * 600, "i2", "@@2"), ("d" * 20, None, None)]), (2, [])], "id int, parts array<struct<text string, image string, position string>>")
    got = {r["id"]: [(c["text"], c["images"]) for c in r["c"]] for r in parts.select("id", chunking.greedy_merge_parts(F.col("parts")).alias("c")).collect()}
    assert got == {1: [("aabb" + "c" * 600 + "@@2", ["i1", "i1", "i2"]), ("d" * 20, [])], 2: []}
    lines = ["Title", "contents", "", "Intro .. 1", "Other .. 2", "Intro", "body", "目 录", "x", "y"]
    sections = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "x"), (3, 0, "contents"), (4, 0, None)], "doc_id long, at int, text string")
    kept = [(r["doc_id"], r["text"]) for r in chunking.without_contents(sections).orderBy("doc_id", "at").collect()]
    assert kept == [(1, "Title"), (1, "Intro"), (1, "body"), (1, "y"), (2, "x"), (4, None)]
    assert chunking.lines_without_contents(["contents", "One two", "a", "One three", "One two b"], english=True) == [4]
    assert chunking.lines_without_contents(["目录", "第一章", *["x"] * 127, "第一章"]) == [129] and chunking.lines_without_contents(["目录", "第一章", *["x"] * 128, "第一章"]) == list(range(2, 131))
    marks = [(0, "Part"), (1, "Chap"), (6, "aa"), (6, "bb"), (1, "Chip"), (2, "Sec"), (6, "c" * 440), (6, "7"), (6, "x"), (0, "Quart"), (6, "ee"), (1, "Rest")]
    levels = spark.createDataFrame([(1, i, min(level, 5), t) for i, (level, t) in enumerate(marks)], "doc_id long, at int, level int, text string")
    merged = [r["content"].split("\n") for r in chunking.hierarchical_merge(levels).orderBy("sequence").collect()]
    assert merged == [["Part", "Chap", "aa"], ["Part", "Chap", "bb"], ["Part", "Chip", "Sec", "c" * 440], ["Quart", "Sec", "ee"], ["Rest"]]
    assert [r["content"] for r in chunking.hierarchical_merge(levels.where("level = 5"), depth=1).collect()] == ["aa\nbb", "c" * 440, "ee"]
    boxes = [("1. what is it", 0, 0), ("more", 0, 30), ("2. next", 5, 60), ("1. falls", 0, 90), ("1.why so", 0, 120), ("3. far in", 30, 150), ("see:", 0, 180), ("4. after colon", 0, 210), ("5. same line", 9, 215)]
    shown = spark.createDataFrame([(1, i, t, float(x), float(y), "text") for i, (t, x, y) in enumerate(boxes)], "doc_id long, at int, text string, x0 double, top double, layout string")
    assert [(r["at"], r["number"]) for r in chunking.question_bullets(shown, 5).orderBy("at").collect() if r["is_bullet"]] == [(0, 1), (2, 2), (4, 1)]
    assert one(spark, chunking.colon_title(F.col("t")), t="A long sentence that comes first and ends here. The title:") == "The title:"
    assert one(spark, chunking.colon_title(F.col("t")), t="Short. The title:") is None and one(spark, chunking.colon_title(F.col("t")), t="no colon") is None
    assert chunking.frequent_level(levels, ["doc_id"], "at", 4).first()["level"] == 1
    styled = [one(spark, chunking.paragraph_level(F.col("s"), F.col("t"), 3), s=s, t=t) for s, t in (("Heading 2", "x"), ("Normal", "Chapter II"), ("Normal", "y"))]
    assert styled == [2, 2, 4]
    box = F.array(F.struct(F.lit(0).alias("page"), *(F.lit(1.7).alias(c) for c in ("left", "right", "top", "bottom"))))
    assert [tuple(p) for p in one(spark, chunking.positions(box))] == [(1, 1, 1, 1, 1)]


def test_dictionary(spark):
    rng = np.random.default_rng(9)
    han = [chr(0x4E00 + i) for i in range(4)]
    terms = {"".join(rng.choice(han, rng.integers(1, 4))): int(rng.integers(1, 900_000)) for _ in range(30)}
    words = lexicon.Words({t: lexicon.weight_of(f) for t, f in terms.items()})

    def ways(text):
        if not text:
            return [[]]
        if text[:5] == 5 * text[0]:
            n = min(10, len(text) - len(text.lstrip(text[0])))
            return [[text[:n], *w] for w in ways(text[n:])]
        first = [text[:k] for k in range(1, len(text) + 1) if text[:k] in terms] or [text[0]]
        return [[f, *w] for f in first for w in ways(text[len(f) :])]

    def score(way):
        return 30 / len(way) + sum(len(x) > 1 for x in way) / len(way) + sum(words.weights.get(x, -12) for x in way)

    for _ in range(60):
        text = "".join(rng.choice(han, rng.integers(1, 11)))
        all_ways = ways(text)
        assert score([text[a:b] for a, b in words.best(text)]) == pytest.approx(max(map(score, all_ways)))
        assert [[text[a:b] for a, b in p] for p in words.paths(text)] == all_ways
        assert "".join(words.split(text)) == text
        longest = lambda x, cut: next(y for y in (cut(x, k) for k in range(len(x), 0, -1)) if y in terms or len(y) == 1)
        left, out = text, []
        while left:
            out.append(longest(left, lambda x, k: x[:k]))
            left = left[len(out[-1]) :]
        assert [text[a:b] for a, b in words.forward(text)] == out
        left, out = text, []
        while left:
            out.insert(0, longest(left, lambda x, k: x[-k:]))
            left = left[: len(left) - len(out[0])]
        assert [text[a:b] for a, b in words.backward(text)] == out
    known = lexicon.lexicon(spark.createDataFrame([("中文", 500.0, "n"), ("中文", 90_000.0, "v"), ("分词", 3000.0, "n"), ("词", 10.0, None), ("c/c++", 5.0, "x")], "term string, freq double, tag string"))
    assert {r["term"]: r["weight"] for r in known.collect()} == {"中文": -1, "分词": -5, "词": -11, "c/c++": -11}
    got = lexicon.frequencies(spark.createDataFrame([("中文",), ("无",)], "term string"), known).collect()
    assert {r["term"]: (r["freq"], r["tag"]) for r in got} == {"中文": (int(math.exp(-1) * 1e6 + 0.5), "v"), "无": (0, "")}
    rows_ = spark.createDataFrame([(1, "中文分词，ＡBC 12"), (2, None)], "k long, text string")
    assert {r["k"]: r["words"] for r in lexicon.segmented(rows_, ["k"], "text", known).collect()} == {1: ["中文", "分词", "abc", "12"], 2: []}
    assert lexicon.Words({"t恤": -3}).merged(["t", "恤", "中"]) == ["t恤", "中"] and lexicon.Words({"a/b": -3}).merged(["a", "/", "b", "c"]) == ["a/b", "c"] and lexicon.fine_grained(words, ["a/b", "c"]) == ["a", "b", "c"]
    fine = lexicon.Words({"甲乙丙": -2, "甲乙": -3, "丙": -4, "甲": -5, "乙": -5})
    assert fine.finer("甲乙丙") == ["甲乙", "丙"] and fine.finer("甲乙") == ["甲乙"]
    assert len(words.split("".join(rng.choice(han, 5000)))) > 1000


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apples grow on trees"), (2, "blue whales swim in seas"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red apples grow on trees"), (8, "zzz")], "query_id long, text string")
    engine = Engine(spark, str(tmp_path), lambda q, texts: f"{len(texts)}: {texts[0].splitlines()[0]}")
    config = Config(threshold=0.7)
    engine.ensure("a", docs, config)
    with pytest.raises(FileExistsError):
        engine.build("a", docs, config)
    assert [(r["query_id"], r["doc_id"]) for r in engine.search("a", queries).collect()] == [(7, 1)]
    rewrites = spark.createDataFrame([(8, 1, "blue whales swim in seas"), (8, 2, "zzz")], "query_id long, place int, text string")
    assert engine.search("a", queries, rewrites=rewrites, use_rerank=False).where("query_id = 8").count() == 2
    assert engine.search("a", queries, keywords=True, threshold=0.0).where("query_id = 7").count() == 2
    assert {r["query_id"]: r["answer"] for r in engine.ask("a", queries).collect()} == {7: "1: 来源文档: 1", 8: NOTHING_FOUND}
    assert {r["query_id"]: r["precision_recall"] for r in engine.evaluate("a", queries).collect()} == {7: 1.0, 8: 1.0}
    assert engine.update("a", docs, config.updated(top_k=1)) == "hot" and engine.load("a")[1].top_k == 1
    assert engine.update("a", docs, config.updated(proc_chunk_token_size=9)) == "rebuild"
    assert [r["mode"] for r in engine.compare(["a"], queries).collect()] == ["a"]
    assert [r["name"] for r in engine.missing(spark.createDataFrame([("a",), ("b",)], "name string")).collect()] == ["b"]
    assert tuple(engine.info("a").first()) == ("a", 2, 0, 2, 64, "HNSW", "cosine", 0)
    done = engine.measure("a", queries)
    assert done["n_queries"] == 2 and done["total_time"] > 0 and done["config"]["proc_chunk_token_size"] == 9

    def broken(*_):
        raise ZeroDivisionError("no model")

    assert {k: v.split(":")[0] for k, v in Engine(spark, str(tmp_path), embed=broken).ensure_all(docs, {"a": config, "b": config}).items()} == {"a": "exists", "b": "ZeroDivisionError"}
    assert Config(index_type="IVF").index_params() == {"nlist": 100, "nprobe": 10} and "metric: cosine" in Config().summary()


def test_engine_settings_have_effect(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(rng.choice(words[i % 3 * 20 : i % 3 * 20 + 20], 30)) for _ in range(12))) for i in range(12)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 8])) for i in range(3)], "query_id long, text string")
    engine = Engine(spark, str(tmp_path))
    config = Config(threshold=0.0, proc_chunk_token_size=100, index_type="Flat")
    engine.build("flat", docs, config)
    engine.build("cells", docs, config.updated(index_type="IVF", ivf_nlist=6, ivf_nprobe=6))
    found = lambda name, **more: {(r["query_id"], r["doc_id"], r["sequence"], r["rank"]): r["vec_score"] for r in engine.search(name, queries, **more).collect()}
    flat = found("flat")
    assert found("cells") == flat and set(found("cells", ivf_nprobe=1)) != set()
    l2 = found("flat", metric="l2")
    want = {k: round(1 / (1 + math.sqrt(max(0, 2 - 2 * v)) + 1e-6), 9) for k, v in flat.items()}
    assert all(l2[k] == pytest.approx(want[k], abs=1e-6) for k in set(l2) & set(want)) and set(l2) & set(want)
    engine.build("trees", docs, config.updated(proc_enable_raptor=True))
    levels = {r["level"] for r in engine.load("trees")[0].chunks.select("level").distinct().collect()}
    assert {0, 1} <= levels and {r["level"] for r in engine.load("flat")[0].chunks.select("level").distinct().collect()} == {0}
    index, config = engine.load("flat")
    alone = retrieval.Index(index.key, index.chunks)
    by_vectors = retrieval.hybrid_search(alone, retrieval.sub_queries(queries), config).collect()
    assert by_vectors and all(r["kw_score"] is None and r["score"] == r["vec_score"] for r in by_vectors)
    fused = retrieval.hybrid_search(alone, retrieval.sub_queries(queries), config.updated(threshold=1 / 62.5), parity=True).collect()
    assert {r["rank"] for r in fused} == {1, 2} and all(r["score"] > 1 / 62.5 for r in fused)
    assert engine.delete("flat") and not engine.exists("flat") and not engine.delete("flat") and not engine.delete("none")
    assert sorted(r["name"] for r in engine.store.list().collect()) == ["cells", "trees"] and engine.clear() == 2 and engine.store.list().count() == 0


def test_followed_documents(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string"
    for i, rows_ in enumerate([[(1, "one"), (2, "two")], [(1, "changed"), (2, None), (3, "three")]]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
        updates.follow(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "checkpoint")).awaitTermination(60)
        got = {r["doc_id"]: r["content"] for r in updates.current(spark, root).collect()}
        assert got == ({1: "one", 2: "two"} if i == 0 else {1: "changed", 3: "three"})


def test_cache_and_ids(spark):
    rows_ = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "k long, text string")
    none = spark.createDataFrame([], "cache_key string, embedding array<double>")
    first, made = retrieval.encode(rows_, none, "m", 8)
    assert made.count() == 3 and first.where("embedding is null").count() == 0 and first.count() == 4
    again, more = retrieval.encode(rows_, made, "m", 8)
    assert more.count() == 0 and again.where("embedding is null").count() == 0
    for buckets in (1, 7):
        got = retrieval.dense_ids(spark.range(50).withColumnRenamed("id", "k").repartition(3), ["k"], 10, buckets)
        assert sorted(r["id"] for r in got.collect()) == list(range(10, 60))
    assert retrieval.dense_ids(rows_.limit(0), ["k"]).count() == 0


def test_references_in_pages_are_closed(spark):
    html = "<p>a&amp;&amp</p><p>&lt;b&gt &copy; &copyright; &#65; &#65 &amp;lt; x&y;"
    got = files.page_elements(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("elem_idx").collect()
    assert [r["text"] for r in got] == ["a&&amp", "<b&gt © &copyright; A &#65 &lt; x&y;"]


def test_groups_are_clustered_as_they_are_alone():
    rng, groups = np.random.default_rng(3), []
    for n in (1, 2, 5, 9, 5, 40, 9, 5):
        x = rng.poisson(1.0, (n, 64)).astype(float)
        groups.append(x[rng.integers(0, n, n)])
    found = tree.group_labels(groups)
    assert [x.tolist() for x in found] == [tree.mixture_labels(x).tolist() for x in groups] and len(set(found[5].tolist())) > 1


def test_whole_groups_across_batches(spark, monkeypatch):
    """Groups go on over the batches that a task is given, and as many as are wanted go together."""
    seen = []
    monkeypatch.setattr(tree, "HELD_ROWS", 4)
    monkeypatch.setattr(tree, "WORD_ROWS", 3)

    def summarised(pdf):
        seen.append(list(zip(pdf["doc_id"], pdf["part"], strict=True)))
        return pdf.iloc[:0].assign(level=0, children=None)[["doc_id", "level", "node", "at", "content", "children"]]

    groups = [(1, 0)] * 2 + [(2, 0)] * 7 + [(2, 1)] + [(3, 0)] * 3
    rows_ = pa.table({"doc_id": [g[0] for g in groups], "node": ["n"] * 13, "at": list(range(13)), "content": ["c"] * 13, "nodes": [0] * 13, "part": [g[1] for g in groups], "t": [["w"]] * 13})
    list(tree._grouped(summarised)(iter(rows_.to_batches(max_chunksize=5))))
    assert sum(seen, []) == groups and all(seen[i][-1] != seen[i + 1][0] for i in range(len(seen) - 1)) and len(seen) > 1


def test_ways_to_split_are_looked_up_once(monkeypatch):
    """The pieces that begin at a place don't depend on how it was reached; words are found by two characters at their ends."""
    words = lexicon.Words({"ab": -3, "abc": -4, "bc": -3, "cd": -2, "d": -5, "bcde": -1, "e": -6})
    asked, edges = Counter(), lexicon.Words.edges
    monkeypatch.setattr(lexicon.Words, "edges", lambda self, text, at: (asked.update([at]), edges(self, text, at))[1])
    assert words.forward("abcdexab") == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 8)] and words.backward("abcdexab") == [(0, 1), (1, 5), (5, 6), (6, 8)]
    assert words.best("abcdeabcd") and max(asked.values()) == 1


def test_stretches_of_any_length_have_the_highest_score():
    """The whole score decides also beyond 40 characters, against all ways by pieces and longer pieces; of equal ones the longest last pieces."""
    rng = np.random.default_rng(4)
    draw = lambda n: "".join(rng.choice(list("甲乙丙"), n))
    for _ in range(25):
        words = lexicon.Words({draw(rng.integers(1, 6)): -int(rng.integers(0, 6)) for _ in range(25)})
        for text in (draw(rng.integers(41, 70)), draw(rng.integers(1, 11))):
            weights = [{(0, 0): 0}] + [{} for _ in text]
            for at in range(len(text)):
                for end, w in words.edges(text, at) if weights[at] else ():
                    for (n, long), weight in weights[at].items():
                        state = (n + 1, long + (end - at > 1))
                        weights[end][state] = max(weights[end].get(state, weight + w), weight + w)
            most = max(Fraction(30 + long, n) + weight for (n, long), weight in weights[-1].items())
            exact = lambda way: Fraction(30 + sum(b - a > 1 for a, b in way), len(way)) + sum(words.weights.get(text[a:b], lexicon.UNKNOWN) for a, b in way)  # noqa: B023, E731
            assert exact(got := words.best(text)) == most
            assert len(text) > 10 or got == min((w for w in words.paths(text) if exact(w) == most), key=lambda w: w[::-1])
    # Of equal weights, the ways of more longer pieces, however much comes before.
    words = lexicon.Words({"甲": -1, "乙": -1, "丙": -1, "甲乙": -2, "乙丙": -2, "甲乙丙": -3})
    for n in (1, 13, 14, 20_000):
        assert words.best("甲乙丙" * n) == [(i, i + 3) for i in range(0, 3 * n, 3)]
    assert words.best("") == []


def test_term_statistics_take_no_postings(spark, monkeypatch):
    monkeypatch.setattr(keyword, "postings_of_words", None)
    chunks = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, None), (4, [])], "doc_id long, words array<string>")
    assert {r["term"]: r["df"] for r in registry._term_stats(chunks).collect()} == {"a": 2, "b": 1}


def test_batches_of_chunks_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(chunking, "BATCH_CHARS", 1000)
    rows_ = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 600] * 9)], names=["doc_id", "text"])

    class Rows:
        schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "bigint"})()})()}
        select = where = lambda self, *_: self

        def mapInArrow(self, run, _):  # noqa: N802
            self.made = [len(b) for b in run(iter([rows_]))]
            raise StopIteration

    own = Rows()
    with pytest.raises(StopIteration):
        chunking.chunk_documents(own)
    assert sum(own.made) == 9 and max(own.made) == 2


def test_words_are_hashed_once_and_go_to_python_alone(spark, monkeypatch):
    """A word of several thousand rows is hashed once for all of them; rows of many words are taken apart, and only words leave the JVM."""
    calls, real = [], search.hashlib.md5
    monkeypatch.setattr(search.hashlib, "md5", lambda *a, **k: calls.append(a) or real(*a, **k))
    rng, few = np.random.default_rng(5), [f"w{i}" for i in range(100_000)]
    rows_ = [[few[i] for i in own] for own in rng.integers(0, 100_000, (3000, 40))] + [None, [], ["ß", "a"] * 2]
    words = pa.array(rows_, pa.list_(pa.string()))
    got = np.concatenate([search.hashed_rows(part, 64) for part in search.word_slices(words)])
    assert len(calls) == len({w for own in rows_ for w in own or []})
    for own, x in zip(rows_, got, strict=True):
        want = np.bincount([int(real(w.encode()).hexdigest()[:8], 16) % 64 for w in own or []], minlength=64)
        assert x.tolist() == (want / (np.sqrt((want * want).sum()) or 1.0)).tolist()
    cut = list(search.word_slices(pa.array([["a"] * n for n in (5, 90, 300, 1, 0, 70)]), 200))
    assert [len(x) for part in cut for x in part] == [5, 90, 300, 1, 0, 70] and len(cut) > 2
    table = spark.createDataFrame([(1, "t", ["x", "y"]), (2, "u", None)], "k long, content string, words array<string>")
    out = search.hash_embeddings(table, table.columns, "words", 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and [sum(x > 0 for x in r["embedding"]) for r in out.orderBy("k").collect()] == [2, 0]
    index_ = retrieval.index_of(table.select("k", "content"), ["k"], 8, with_text=False)
    assert sorted(index_.chunks.columns) == ["embedding", "k", "words"]


def test_keyword_scores_meet_the_queries_that_ask(spark):
    """A term that few queries ask has postings, one that many ask a column; rows meet no other queries, and the scores are those of all products."""
    rng = np.random.default_rng(11)
    asked = {i: {f"w{w}": float(x) for w, x in zip(rng.integers(0, 300, 6), rng.uniform(0.1, 4, 6), strict=True)} | {"often": 0.5 + i} | {"never": 0.0} for i in range(30)}
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "query_id long, embedding array<double>")
    weights = spark.createDataFrame([(i, t, w) for i, own in asked.items() for t, w in own.items()], "query_id long, term string, weight double")
    (block,) = exhaustive.query_blocks(q, weights)
    many = [t for t in block.terms.to_pylist() if sum(own.get(t, 0.0) != 0 for own in asked.values()) > exhaustive.DENSE]
    assert "often" in many and block.matrix.shape == (30, len(many))
    assert len(block.askers) + np.count_nonzero(block.matrix) == sum(w != 0 for own in asked.values() for w in own.values())
    rows_ = [[f"w{w}" for w in rng.integers(0, 400, n)] + ["often"] * (n % 3) for n in rng.integers(1, 60, 50)] + [None, [], ["never"]]
    scores, shared = exhaustive._keyword_scores(block, pa.array(rows_, pa.list_(pa.string())).slice(1), 30.0, matches=True)
    for at, i in enumerate(block.ids.to_pylist()):
        for j, own in enumerate(r or [] for r in rows_[1:]):
            want = sum(w * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / 30.0)) for t, w in asked[i].items())
            assert scores[at, j] == pytest.approx(want, abs=1e-12) and shared[at, j] == any(asked[i].get(t) for t in own)


def test_rows_of_candidates_are_not_shuffled(spark, monkeypatch):
    """The words of all rows stay where they are, whatever the session's limit for broadcasts; too many candidates meet them in a shuffle, with the same scores."""
    rows_ = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", "x"]) for i in range(60)], "c long, words array<string>")
    candidates = spark.createDataFrame([(q, c) for q in range(3) for c in range(q, 60, 5)], "query_id long, c long")
    asked = spark.createDataFrame([(q, s, f"w{q + s}", 1 + s, 0.5) for q in range(3) for s in range(2)], "query_id long, sub_idx int, term string, qtf long, idf double")
    limit_before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for limit, joins in ((1 << 19, 1), (35, 0)):
            monkeypatch.setattr(keyword, "BROADCAST_CANDIDATES", limit)
            out = keyword.row_scores(candidates, rows_, asked, ["c"], 3.0)
            assert out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == joins
            found.append(sorted(map(tuple, out.collect())))
        assert found[0] == found[1] and found[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit_before)


def test_a_search_by_vectors_keeps_no_words(spark, tmp_path, monkeypatch):
    """Searches without keyword scores count and store no words; what they find is what an index with keywords finds."""
    made, real = [], retrieval.index_of
    monkeypatch.setattr(retrieval, "index_of", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 9))) for i in range(1, 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"w{i} w{2 * i} w{3 * i}") for i in range(1, 6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("search_without_rerank", "search_vector_only", "search_fused_threshold"):
        made.clear()
        found = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
        assert made[0].term_stats is None and sorted(made[0].chunks.columns) == ["doc_id", "embedding", "sequence"]
        monkeypatch.setattr(retrieval, "index_of", lambda *a, **k: real(*a, **k | {"with_keywords": True}))
        assert found == sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
        monkeypatch.setattr(retrieval, "index_of", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
        assert found or name == "search_vector_only"


def test_document_frequencies_are_counted_beside_the_embeddings(spark, monkeypatch):
    """Frequencies come as sums for many rows at once, so that an index doesn't go through all words again; they are those of the rows' words."""
    table = spark.createDataFrame([(i, None if i == 7 else " ".join(f"w{(i * j) % 31}" for j in range(i % 50))) for i in range(300)], "k long, content string").repartition(3)
    worded = table.select("k", T.tokens(F.col("content")).alias("words"))
    want = sorted(map(tuple, keyword.frequencies(worded).collect()))
    counted = worded.withColumn("d", keyword.partial_frequencies("words"))
    stored = kept(counted)
    assert sorted(map(tuple, keyword.summed_frequencies(stored, "d").collect())) == want
    assert 1 <= stored.where(F.size("d") > 0).count() < 10
    both = search.hash_embeddings(counted, counted.columns, "words", 8)
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    monkeypatch.setattr(keyword, "frequencies", None)
    made = retrieval.index_of(table, ["k"], 8)
    assert sorted((r["term"], r["df"]) for r in made.term_stats.collect()) == want and sorted(made.chunks.columns) == ["content", "embedding", "k", "words"]
    assert made.avgdl == pytest.approx(sum(df for df in worded.select(F.size("words")).toPandas().iloc[:, 0] if df > 0) / worded.where(F.size("words") > 0).count())
    assert retrieval.index_of(table.limit(0), ["k"], 8).term_stats.count() == 0
