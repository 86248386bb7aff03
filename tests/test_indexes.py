"""Indexes that grow, neighbour graphs, filters inside a search, and tokenizers."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.engine import Engine
from strataflow.functions.stems import measure, stem
from strataflow.functions.text import tokens
from strataflow.operators import graph, search, segmentation
from strataflow.plans.config import Config
from strataflow.sources.store import ConcurrentChange

SCHEMA = "doc_id string, text string"


def documents(n=30, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    return [(f"d{i}", "\n".join(" ".join(rng.choice(words[i % 3 * 20 : i % 3 * 20 + 25], 30)) for _ in range(8))) for i in range(n)]


def found(engine, name, queries, **options):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["sequence"], r["score"], round(r["kw_score"], 9)) for r in engine.search(name, queries, **options).collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(f"q{i}", " ".join(f"w{j}" for j in range(i * 20, i * 20 + 8))) for i in range(3)], "query_id string, text string")


@pytest.mark.parametrize("index_type", ["Flat", "HNSW"])
def test_growing_gives_what_building_gives(spark, tmp_path, queries, index_type):
    docs, engine = documents(), Engine(spark, str(tmp_path))
    config = Config(threshold=0.0, proc_chunk_token_size=60, index_type=index_type, hnsw_ef=500)
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    engine.build("grown", table(docs[:12]), config)
    engine.append("grown", table(docs[12:25]))
    engine.append("grown", table([("d3", "w1 w2 w3 all new"), *docs[25:]]))
    engine.remove("grown", spark.createDataFrame([("d5",), ("d20",), ("never",)], "doc_id string"))
    engine.append("grown", table([docs[20]]))
    whole = [d for d in docs if d[0] not in ("d3", "d5")] + [("d3", "w1 w2 w3 all new")]
    engine.build("whole", table(whole), config)
    want = found(engine, "whole", queries)
    assert found(engine, "grown", queries) == want and len(want) == 15
    stats = lambda x: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in x.term_stats.collect())
    a, b = engine.load("grown")[0], engine.load("whole")[0]
    assert a.avgdl == b.avgdl and stats(a) == stats(b)
    engine.compact("grown", vacuum=True)
    state = engine.store.state("grown")[1]
    assert len(state["segments"]) == 1 and not state["removed"] and len(list((tmp_path / "grown" / "parts").iterdir())) == 2
    assert found(engine, "grown", queries) == want


def test_a_failed_change_leaves_the_version_before(spark, tmp_path, queries, monkeypatch):
    docs, engine = documents(6), Engine(spark, str(tmp_path))
    config = Config(threshold=0.0, index_type="Flat")
    engine.build("a", spark.createDataFrame(docs[:4], SCHEMA), config)
    before, reader = found(engine, "a", queries), engine.load("a")[0]

    def broken(*_):
        raise OSError("the disk is full")

    with monkeypatch.context() as m:
        m.setattr(engine.store, "commit", broken)
        for change in (lambda: engine.append("a", spark.createDataFrame(docs[4:], SCHEMA)), lambda: engine.build("a", spark.createDataFrame(docs, SCHEMA), config, replace=True)):
            with pytest.raises(OSError):
                change()
        assert found(engine, "a", queries) == before
    engine.build("a", spark.createDataFrame(docs[4:], SCHEMA), config, replace=True)
    assert {r["doc_id"] for r in reader.chunks.collect()} == {d[0] for d in docs[:4]}
    assert {r[2] for r in found(engine, "a", queries)} == {d[0] for d in docs[4:]}
    version, state = engine.store.state("a")
    engine.store.commit("a", version, state)
    with pytest.raises(ConcurrentChange):
        while True:  # the greater writer's name loses
            engine.store.commit("a", version, state)
    assert engine.store.state("a")[0] == version + 1


@pytest.mark.parametrize("index_type", ["Flat", "IVF", "HNSW"])
def test_filters_hold_before_the_best_are_chosen(spark, tmp_path, queries, index_type):
    engine = Engine(spark, str(tmp_path))
    engine.build("a", spark.createDataFrame(documents(), SCHEMA), Config(threshold=0.0, proc_chunk_token_size=60, index_type=index_type, ivf_nlist=5, ivf_nprobe=5))
    wanted = F.col("doc_id").isin("d1", "d7", "d9")
    got = engine.search("a", queries, where=wanted).collect()
    assert {r["doc_id"] for r in got} <= {"d1", "d7", "d9"} and [r["query_id"] for r in got].count("q0") == 5
    index, config = engine.load("a")
    vectors = search.hash_embeddings(queries.select("query_id", tokens(F.col("text")).alias("words")), ["query_id"], "words", config.embed_dim)
    best = search.exact_top_k(index.chunks.where(wanted), index.key, vectors, 125).collect()
    every = engine.search("a", queries, where=wanted, use_rerank=False).collect()
    assert sorted((r["query_id"], r["doc_id"], r["sequence"], r["vec_score"]) for r in every) == sorted((r["query_id"], r["doc_id"], r["sequence"], r["score"]) for r in best)
    assert engine.search("a", queries, where=F.col("level") > 0).count() == 0


def test_trees_of_documents_with_names(spark, tmp_path, queries):
    engine = Engine(spark, str(tmp_path))
    engine.build("trees", spark.createDataFrame(documents(3), SCHEMA), Config(threshold=0.0, proc_enable_raptor=True, proc_chunk_token_size=60))
    assert engine.search("trees", queries, where=F.col("level") > 0).select("doc_id").distinct().count() > 0


# --- graphs ---


def clustered(n, d, seed, centres=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("m,ef_con,ef,recall,share", [(64, 200, 128, 0.99, 0.9), (16, 100, 64, 0.9, 0.35), (8, 50, 32, 0.9, 0.2)])
def test_recall_of_a_graph(m, ef_con, ef, recall, share):
    x, q = clustered(2000, 24, 1), clustered(100, 24, 1)
    layers = graph.layers_of(x, np.random.default_rng(3).random(2000), m, ef_con)
    scores, nodes, taken = graph.searched(x, layers, q, 10, ef)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes, want, strict=True)]) >= recall
    assert taken <= share * 100 * 2000
    assert all(links.shape[1] <= (2 * m if i == 0 else m) for i, (_, links) in enumerate(layers))
    assert np.allclose(scores, np.take_along_axis(q @ x.T, nodes, axis=1))


def test_links_are_chosen_by_nearness_and_direction():
    """Of two near ones in one direction the nearer is chosen; the other direction has room."""
    angles = np.array([0.0, 0.1, 0.15, -0.4])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert set(graph.linked(x, 2, 2, 3)[0].tolist()) == {1, 3} and set(graph.linked(x, 2, 4, 3)[0].tolist()) - {-1} == {1, 2, 3}


@pytest.mark.parametrize("rows", [4096, 300, 1])
def test_graphs_against_exact_search(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "GRAPH_ROWS", rows)
    x = clustered(700, 16, 2)
    data = [(i % 50, i // 50, v.tolist()) for i, v in enumerate(x)] + [(99, 0, None), (99, 1, [0.0] * 16)]
    vectors = spark.createDataFrame(data, "a long, b int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(clustered(40, 16, 2))], "query_id string, embedding array<double>")
    made = graph.graphs(vectors, ["a", "b"], 16, 100)
    got = graph.search_graphs(made, ["a", "b"], asked, 10, 80).collect()
    want = search.exact_top_k(vectors.where("embedding IS NOT NULL"), ["a", "b"], asked, 10).collect()
    same = {(r["query_id"], r["a"], r["b"], r["score"]) for r in got} & {(r["query_id"], r["a"], r["b"], r["score"]) for r in want}
    assert len(got) == 400 and len(same) >= 0.95 * 400
    assert graph.search_graphs(made, ["a", "b"], asked.limit(0), 10, 80).count() == 0


# --- tokenizers ---


def test_most_probable_path():
    rng = random.Random(2)
    for _ in range(40):
        freq = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): float(rng.randint(1, 50)) for _ in range(8)}
        g = segmentation.Graph(freq)
        for _ in range(10):
            text = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 9)))
            best = -math.inf
            for cuts in product([0, 1], repeat=len(text) - 1):
                words, at = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        words.append(text[at:i])
                        at = i
                if all(len(w) == 1 or w in freq for w in words):
                    best = max(best, sum(g.weights.get(w, g.unknown) for w in words))
            path = g.path(text)
            assert "".join(path) == text and sum(g.weights.get(w, g.unknown) for w in path) == best


def test_tagger_against_all_tags(spark):
    said = [(["我们", "在", "学习", "机器学习"],), (["他", "学习", "中文"],), (["机器", "在", "我们", "这里"],), (None,), ([],), ([""],)]
    counts = [tuple(r) for r in segmentation.tag_counts(spark.createDataFrame(said, "words array<string>")).collect()]
    assert ("start", "B", "", 2) in counts and ("next", "M", "M", 1) in counts and ("sign", "B", "学", 2) in counts and ("sign", "S", "在", 2) in counts
    tagger = segmentation.Tagger.of(counts)
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("我们在学习机器中文新") for _ in range(rng.randint(1, 6)))

        def score(tags, text=text):
            if tags[0] not in "BS" or tags[-1] not in "ES" or any(b not in segmentation.FOLLOWING[a] for a, b in zip(tags, tags[1:], strict=False)):
                return -math.inf
            return tagger.start[tags[0]] + sum(tagger.following[a, b] for a, b in zip(tags, tags[1:], strict=False)) + sum(tagger.signs.get((t, c), tagger.unseen[t]) for t, c in zip(tags, text, strict=True))

        tags = tagger.tags(text)
        assert score(tags) == max(map(score, product("BMES", repeat=len(text)))) and "".join(tagger.words(text)) == text


def test_chinese_words_in_an_index(spark, tmp_path):
    """A word that stands inside other characters is found by its own; unknown words are put together by the tagger."""
    terms = spark.createDataFrame([("数据", 50.0), ("数据库", 40.0), ("分析", 60.0), ("苹果", 30.0), ("红", 5.0), ("的", 90.0), ("存储", 20.0), ("果树", 1.0), ("", 3.0), ("零", 0.0)], "term string, freq double")
    said = spark.createDataFrame([(["数据", "的", "分析"],), (["区块", "存储"],), (["区块", "链接"],)], "words array<string>")
    tokenize = segmentation.segmenter(terms, segmentation.tag_counts(said), stems=True)
    texts = spark.createDataFrame([(1, "红苹果的数据库"), (2, "数据分析，ＲＵＮＮＩＮＧ区块"), (3, None), (4, "x1 café")], "k long, text string")
    got = {r["k"]: r["words"] for r in texts.select("k", tokenize(F.col("text")).alias("words")).collect()}
    assert got == {1: ["红", "苹果", "的", "数据库"], 2: ["数据", "分析", "run", "区块"], 3: [], 4: ["x1", "café"]}
    docs = spark.createDataFrame([(1, "红苹果的数据库存储"), (2, "数据分析的苹果"), (3, "存储的分析")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "数据库"), (2, "数据")], "query_id long, text string")
    engine = Engine(spark, str(tmp_path), tokenize=tokenize)
    engine.build("words", docs, Config(threshold=0.0, top_k=1))
    assert {(r["query_id"], r["doc_id"]) for r in engine.search("words", asked).collect()} == {(1, 1), (2, 2)}
    assert {r["precision_recall"] for r in engine.evaluate("words", asked.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "text")).collect()} == {1.0}
    plain = Engine(spark, str(tmp_path))
    plain.build("runs", docs, Config(threshold=0.0))
    assert all(r["kw_score"] == 0 for r in plain.search("runs", asked).collect())
    with pytest.raises(ValueError):
        segmentation._collected(spark.range(5), 4, "a dictionary")


# Examples of the published description.
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil""".split()


def test_stems(spark):
    assert [stem(w) for w in EXAMPLES[::2]] == EXAMPLES[1::2]
    assert [measure(w) for w in ("tree", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 1, 1, 1, 1, 2, 2, 2]
    assert [stem(w) for w in ("is", "x1s", "cafés", "")] == ["is", "x1s", "cafés", ""]
    rows = spark.createDataFrame([(1, "Running dogs ran"), (2, None)], "k long, text string")
    assert {r["k"]: r["w"] for r in rows.select("k", segmentation.stemmed(tokens)(F.col("text")).alias("w")).collect()} == {1: ["run", "dog", "ran"], 2: []}
