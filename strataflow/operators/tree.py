"""Hierarchical summaries: the chunks of each document are clustered, summarised and clustered again, all documents at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.stored import kept
from .search import hashed_rows


#: Rows whose words are hashed at once.
WORD_ROWS = 1000
#: Rows whose mixtures are fitted at once, and rows and bytes of whole groups that a task looks through for those of one size.
AT_ONCE, HELD_ROWS, HELD_BYTES = 512, 1 << 14, 16 << 20
#: The dimension of a node's embedding.
DIM = 64


def mixture_labels(x: np.ndarray, max_clusters: int = 10, seed: int = 42, rounds: int = 12) -> np.ndarray:
    """Labels of the Gaussian mixture (diagonal, on the leading principal components) with the least BIC; under 3 rows: one cluster."""
    return group_labels([x], max_clusters, seed, rounds)[0]


def group_labels(groups: list[np.ndarray], max_clusters: int = 10, seed: int = 42, rounds: int = 12) -> list[np.ndarray]:
    """``mixture_labels`` of each group; groups of as many rows go through each step together."""
    out = [np.zeros(len(x), dtype=np.int64) for x in groups]
    by_size = defaultdict(list)
    for i, x in enumerate(groups):
        if len(x) > 2:
            by_size[len(x)].append(i)
    for n, own in by_size.items():
        step = max(1, AT_ONCE // n)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            for i, labels in zip(some, _fitted(np.stack([groups[i] for i in some]), max_clusters, seed, rounds), strict=True):
                out[i] = labels
    return out


def _fitted(x: np.ndarray, max_clusters: int, seed: int, rounds: int) -> np.ndarray:
    """Labels by group and row. x: group x row x dimension."""
    n = x.shape[1]
    centred = x - x.mean(axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    z = centred @ axes[:, : max(2, min(12, n - 1))].transpose(0, 2, 1)
    d, squares, least, best = z.shape[2], z * z, np.full(len(x), np.inf), np.zeros(x.shape[:2], dtype=np.int64)
    spread, order = z.var(axis=1, keepdims=True) + 1e-6, np.random.default_rng(seed).permutation(n)
    for k in range(2, min(max_clusters, n - 1) + 1):
        mean, var, weight = z[:, order[:k]], np.repeat(spread, k, axis=1), np.full((len(x), k), 1 / k)
        for _ in range(rounds):
            parts = z[:, :, None] - mean[:, None]
            parts *= parts
            parts /= var[:, None]
            log = np.log(weight)[:, None] - 0.5 * (parts.sum(axis=3) + np.log(2 * np.pi * var).sum(axis=2)[:, None])
            top = log.max(axis=2, keepdims=True)
            total = top[:, :, 0] + np.log(np.exp(log - top).sum(axis=2))
            r = np.exp(log - total[:, :, None])
            mass = r.sum(axis=1) + 1e-9
            weight, mean = mass / mass.sum(axis=1, keepdims=True), r.transpose(0, 2, 1) @ z / mass[:, :, None]
            var = r.transpose(0, 2, 1) @ squares / mass[:, :, None] - mean**2
            var = np.maximum(var, 1e-6)
        bic = -2 * total.sum(axis=1) + (k - 1 + 2 * k * d) * np.log(n)
        better = bic < least
        least[better], best[better] = bic[better], log.argmax(axis=2)[better]
    return best


def first_words(texts: list[str]) -> str:
    """The summary without a language model: the beginning of the first text."""
    return "这些文档的核心内容是关于：" + texts[0][:150] + "..."


#: Nodes of a document that are clustered together; those of a longer one are dealt into parts of so many, in their order.
PART = 1000


def summary_tree(chunks: DataFrame, summarise: Callable[[list[str]], str] = first_words, max_clusters: int = 10, part: int = PART) -> DataFrame:
    """``doc_id, level, node, content, children``: level 0 are the chunks; each further level summarises clusters of the one below.

    A document stops at one node. Blank summaries are dropped. One job for a level, over all documents; a group is at most ``part`` nodes of
    one document that follow each other, so a long document takes several tasks. A task reads its groups in order and clusters those of one size together.
    """
    node = F.concat(F.col("doc_id").cast("string"), F.lit("_text_"), F.col("sequence").cast("string"))
    level = kept(chunks.select("doc_id", F.lit(0).alias("level"), node.alias("node"), F.col("sequence").cast("long").alias("at"), "content", F.array().cast("array<string>").alias("children")))
    schema = f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, level int, node string, at long, content string, children array<string>"
    out = level
    for depth in count(1):  # from level 2 on each has fewer nodes
        # Few documents have several parts.
        long = kept(level.groupBy("doc_id").agg(F.count("*").alias("nodes")).where(F.col("nodes") > part))
        sized = level.where(F.col("doc_id").isNotNull()).select("doc_id", "node", "at", "content").join(long, "doc_id", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
        # Places are numbers with gaps at most; parts by place have at most as many nodes.
        dealt = sized.withColumn("part", F.when(F.col("nodes") > part, F.floor(F.col("at") / part)).otherwise(0))
        ordered = dealt.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", F.asc_nulls_last("at"), "node").withColumn("t", tokens(F.col("content")))
        level = kept(ordered.mapInArrow(_grouped(_level_function(depth, summarise, max_clusters, part)), schema))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("at")


def _starts(doc_id: pa.Array, part: pa.Array) -> np.ndarray:
    """Where the groups of ordered rows begin."""
    changed = np.zeros(max(0, len(part) - 1), dtype=bool)
    for c in (doc_id, part):
        changed |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], 1 + np.flatnonzero(changed)])


def _grouped(summarised: Callable) -> Callable:
    """Ordered rows with their words ``t`` go to a function as frames of whole groups with their ``embedding``, and no more than are needed to have many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vectors, rows, size = [], [], 0, 0

        def done(table: pa.Table, x: np.ndarray) -> pa.RecordBatch:
            kinds = [("doc_id", table.schema.field("doc_id").type), ("level", pa.int32()), ("node", pa.string()), ("at", pa.int64()), ("content", pa.string()), ("children", pa.list_(pa.string()))]
            found = summarised(table.to_pandas().assign(embedding=list(x)))
            return pa.RecordBatch.from_pandas(found, schema=pa.schema(kinds), preserve_index=False)

        for whole in batches:
            for at in range(0, whole.num_rows, WORD_ROWS):
                batch = whole.slice(at, WORD_ROWS)
                vectors.append(hashed_rows(batch.column("t"), DIM))
                held.append(batch.select(["doc_id", "node", "at", "content", "nodes", "part"]))
                rows, size = rows + batch.num_rows, size + held[-1].nbytes
                if rows >= HELD_ROWS or size >= HELD_BYTES:
                    table, x = pa.Table.from_batches(held).combine_chunks(), np.concatenate(vectors)
                    # The last group may go on.
                    end = int(_starts(*(table.column(c).combine_chunks() for c in ("doc_id", "part")))[-1])
                    if end:
                        yield done(table.slice(0, end), x[:end])
                    held, vectors, rows = table.slice(end).to_batches(), [x[end:]], len(x) - end
                    size = sum(b.nbytes for b in held)
        if rows:
            yield done(pa.Table.from_batches(held), np.concatenate(vectors))

    return run


def _level_function(depth: int, summarise: Callable[[list[str]], str], max_clusters: int, part: int) -> Callable:
    """A frame of whole groups, their rows in order, to the nodes of the next level."""

    def summarised(pdf):
        import pandas as pd

        docs, pieces, several = pdf["doc_id"].tolist(), pdf["part"].tolist(), (pdf["nodes"] > part).tolist()
        nodes, contents, x = pdf["node"].to_numpy(), pdf["content"].to_numpy(), np.stack(pdf["embedding"])
        starts = _starts(pa.array(docs), pa.array(pieces)).tolist()
        # A node that is alone in its part goes up with the others of its document.
        groups = [(a, b) for a, b in zip(starts, [*starts[1:], len(docs)], strict=True) if b - a > 1 or several[a]]
        rows = []
        for (a, b), labels in zip(groups, group_labels([x[a:b] for a, b in groups], max_clusters), strict=True):
            doc_id, piece = docs[a], int(pieces[a])
            if depth > 1 and len(set(labels.tolist())) == b - a:
                labels = np.zeros(b - a, dtype=np.int64)
            for c in sorted(set(labels.tolist())):
                own = a + np.flatnonzero(labels == c)
                text = summarise(contents[own].tolist())
                if text.strip():
                    name = f"{doc_id}_level{depth}_node{f'{piece}_{c}' if several[a] else c}"
                    rows.append((doc_id, depth, name, piece * max_clusters + c, text, nodes[own].tolist()))
        return pd.DataFrame(rows, columns=["doc_id", "level", "node", "at", "content", "children"])

    return summarised
