"""Conversion by the longest phrase."""

import random

from pyspark.sql import functions as F

from strataflow.operators import lexicon, phrases, segmentation


def test_longest_phrases():
    rng = random.Random(3)
    for _ in range(200):
        table = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.choice(["", "X", "YZ", "a"]) for _ in range(6)}
        text = "".join(rng.choices("abcd", k=20))
        want, at = "", 0
        while at < len(text):
            hit = max((p for p in table if text.startswith(p, at)), key=len, default=None)
            want += text[at] if hit is None else table[hit]
            at += len(hit) if hit else 1
        assert phrases.Phrases(table).convert(text) == want


def test_characters_with_several_counterparts(spark, monkeypatch):
    mapping = spark.createDataFrame([("發", "发"), ("髮", "发"), ("乾", "干"), ("乾坤", "乾坤"), ("乾隆", "乾隆"), ("頭", "头"), ("", "x"), ("x", None), ("頭", "投")], "source string, target string")
    convert = phrases.converter(mapping)
    rows = spark.createDataFrame([(1, "頭髮乾了"), (2, "乾坤與乾隆發展"), (3, None), (4, "")], "k long, text string")
    assert {r["k"]: r["t"] for r in rows.select("k", convert(F.col("text")).alias("t")).collect()} == {1: "头发干了", 2: "乾坤與乾隆发展", 3: None, 4: ""}
    known = lexicon.lexicon(spark.createDataFrame([("头发", 500.0, "n"), ("干", 50.0, "a")], "term string, freq double, tag string"))
    assert {r["k"]: r["words"] for r in lexicon.segmented(rows, ["k"], "text", known, convert).collect()}[1] == ["头发", "干", "了"]
    tokenize = segmentation.segmenter(spark.createDataFrame([("头发", 5.0), ("干", 2.0)], "term string, freq double"), convert=convert)
    assert rows.where("k = 1").select(tokenize(F.col("text")).alias("w")).first()["w"] == ["头发", "干", "了"]
    monkeypatch.setattr(phrases, "MOST_PHRASES", 3)
    try:
        phrases.converter(mapping)
    except ValueError:
        return
    raise AssertionError("a table beyond the bound was taken")
