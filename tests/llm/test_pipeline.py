"""The pipeline's stages against brute force, each on its own input."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strataflow.llm import bpe_codec

from .test_near_copies import brute_groups
from .test_text_operators import brute_contamination, brute_lines

COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    long = [" ".join(word() for _ in range(400)) for _ in range(3)]
    own = [*texts, *long, long[0].replace(long[0].split()[100], "changed", 1), long[1] + " more", *["clean words here " + word() for _ in range(60)], *[f"{word()} nastyword {word()}" for _ in range(60)]]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int("nastyword" in (t or ""))) for i, t in enumerate(own) if i >= len(own) - 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, long[2][300:420]), (2, "nothing of this is anywhere in any of those documents here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r[1] for r in rows}, items


def test_stages(spark, tables, monkeypatch):
    d, texts, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == COLUMNS
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left == {i: t for i, t in texts.items() if "nastyword" not in (t or "")}

    lined = stages["line_dedup"](spark, docs, d)
    want = brute_lines(list(texts.values()), list(texts))
    got = {r["doc_id"]: r for r in lined.collect()}
    assert lined.columns == COLUMNS and {i: r["text"] or "" for i, r in got.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values()) and got[[i for i, t in texts.items() if t is None][0]]["text"] is None

    ids = list(texts)
    groups = brute_groups([texts[i] for i in ids])
    keep = {i for k, i in enumerate(ids) if groups[k] is None or groups[k] == k}
    assert len(keep) < len(ids) - 4
    for limit, rows in ((pipeline.GONE_BYTES, docs), (0, docs), (pipeline.GONE_BYTES, docs.union(docs.limit(0)))):
        monkeypatch.setattr(pipeline, "GONE_BYTES", limit)
        near = stages["near_dedup"](spark, rows, d)
        assert near.columns == COLUMNS and {r["doc_id"] for r in near.collect()} == keep

    pure = stages["decontamination"](spark, docs, d)
    hits = brute_contamination([texts[i] for i in ids], items)
    assert pure.columns == COLUMNS and {r["doc_id"] for r in pure.collect()} == {i for i in ids if not hits[i][1]}
    assert sum(bool(hits[i][1]) for i in ids) == 1

    encoding = bpe_codec.load_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in stages["tokens"](spark, docs, d).collect()} == {i: encoding.encode_ordinary(texts[i] or "") for i in ids}


def test_rows_are_told_apart_however_scans_are_cut(spark, tables, monkeypatch):
    """The scan is cut otherwise, as when an executor is lost, after the rows that go have been written."""
    d, texts, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = {r["doc_id"] for r in pipeline.copies_out(spark, docs, d).collect()}
    lazy = pipeline.copies_out(spark, docs, d)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert {r["doc_id"] for r in lazy.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_rows_and_long_files(spark, tmp_path):
    """Over 32,768 rows in one file, ids that repeat and null ids: one row of each group stays."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 1000 == 7, None).otherwise(F.col("id") % 39_000).alias("doc_id"),
        F.concat_ws(" ", *(F.md5(F.concat((F.col("id") % 30_000).cast("string"), F.lit(f"-{i}"))) for i in range(12))).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(396).cast("long").alias("n_chars"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.copies_out(spark, docs, str(tmp_path))
    assert kept.count() == kept.select("text").distinct().count() == 30_000


def test_run(spark, tables, tmp_path):
    d, _, _ = tables
    out = pipeline.run(spark, d)
    assert out.count() > 30
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
