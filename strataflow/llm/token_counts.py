"""Token counts from distinct pre-tokens (operator 2).

1. A pass over the texts counts pre-tokens, combined inside each task, then by a grouped sum.
2. Each distinct pre-token is encoded once; only the number of its pieces is kept.
3. A second pass joins these numbers to each document's own pre-token frequencies: the most frequent pre-tokens
   (at most ``head_rows`` of at most ``HEAD_CHARS`` characters, whatever the input's size) come from a broadcast table, and so do, by their digests,
   longer ones that are more than one in HOT of all pre-tokens, of which there are fewer than HOT; the rest, a few per
   cent of the occurrences, go through a shuffled join. Ids are never made for a document.

A special string inside a text is one token, as the library has it by default; the text on either side is split on its own.
Null or empty text: 0 bytes and 0 tokens. Very long texts: a text's distinct pre-tokens are in memory. Repeated rows: one output row
each. Empty table: no rows. Columns of docs other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import head_threshold, keyed_texts, written

HEAD_CHARS = 64
HOT = 10_000
#: The split of a byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokenizer(tokenizer_path: str):
    """A function from a text to its pre-tokens, special strings being pre-tokens of their own."""
    import json

    import regex

    with open(tokenizer_path, encoding="utf-8") as f:
        parts = json.load(f)
    split_by = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or (split_by.get("type"), split_by.get("use_regex", True), split_by.get("add_prefix_space")) != ("ByteLevel", True, False):
        raise ValueError("only files without a normalizer and with a plain byte-level pre-tokenizer are split as the library does")
    added = parts.get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is around them")
    special = [t["content"] for t in added]
    find = regex.compile(SPLIT).findall
    if not special:
        return find
    pieces = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(pieces.split(text)):
            out += [part] if i % 2 else find(part)
        return out

    return split


def pretoken_counts(texts: DataFrame, tokenizer_path: str, flush_at: int = 400_000) -> DataFrame:
    """``pretoken, n``: how often each distinct pre-token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = pretokenizer(tokenizer_path), Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pretoken", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
                if len(counts) > flush_at:
                    yield flushed()
        yield flushed()

    return texts.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``pretoken, n, pieces``: each distinct pre-token encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            found = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int32())], names=["pretoken", "n", "pieces"])

    return pretokens.select("pretoken", "n").mapInArrow(run, "pretoken string, n long, pieces int")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, head_rows: int = 1 << 18) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: the number of tokens of each whole text."""
    texts = keyed_texts(docs)
    pieces = written(piece_counts(pretoken_counts(texts, tokenizer_path), tokenizer_path))
    least = head_threshold(pieces, "n", head_rows)
    in_head = (F.col("n") >= least) & (F.length("pretoken") <= HEAD_CHARS)
    hot = ~in_head & (F.length("pretoken") > HEAD_CHARS) & (F.col("n") * HOT > (pieces.agg(F.sum("n")).first()[0] or 0))
    head = {r["pretoken"]: r["pieces"] for r in pieces.where(in_head).select("pretoken", "pieces").toLocalIterator()}
    long = {r["digest"]: r["pieces"] for r in pieces.where(hot).select(F.md5("pretoken").alias("digest"), "pieces").toLocalIterator()}
    head = docs.sparkSession.sparkContext.broadcast((head, long))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, (known, long) = pretokenizer(tokenizer_path), head.value
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, rest = 0, []
                for token, n in Counter(split(text)).items():
                    k = known.get(token)
                    if k is None and long and len(token) > HEAD_CHARS:
                        k = long.get(md5(token.encode()).hexdigest())
                    if k is None:
                        rest.append((rid, doc_id, None, n, token))
                    else:
                        own += k * n
                # The document's own row: a key of its own keeps these rows apart in the join.
                for row in [(rid, doc_id, len(text.encode()), own, f"\x00{rid}"), *rest]:
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                    cols = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names, types = ["rid", "doc_id", "n_bytes", "k", "pretoken"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    parts = texts.mapInArrow(run, "rid long, doc_id long, n_bytes long, k long, pretoken string")
    tail = pieces.where(~in_head & ~hot).select("pretoken", "pieces")
    joined = parts.join(tail, "pretoken", "left")
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("k")).otherwise(F.col("k") * F.col("pieces"))
    return (
        joined.groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
