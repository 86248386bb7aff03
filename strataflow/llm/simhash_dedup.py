"""SimHash near-dedup by the generalised pigeonhole principle (operator 9; partitions and candidates are in ``pigeonhole``).

``near_duplicates`` links texts whose 64-bit fingerprints differ in at most ``max_bits`` bits:

1. Each text gives a fingerprint; equal ones become one row, so that copies cost nothing further.
2. Fingerprints meet by partition value and are verified. A bucket of more than ``bucket_rows`` goes another exact way for 2
   bits: each of its fingerprints gives the 65 values within 1 bit of it; those that share one are within 2 bits of each other,
   and any two within 2 bits share one, so each group (65 rows at most) needs only a link to its least row.
3. The links' connected components are found by alternating stars.

``near_copies`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Its fingerprints have ten
independent words of 64 bits, the majorities over a text's distinct words (which near copies share more of than shingles). Each
word is probed within 1 bit, by two partitions of 32 bits; candidates are at most ``FAR_BITS`` of the 640 bits apart. Those whose sketches
(parities of 512 classes of shingles) differ in more bits than the sets may in shingles go; the others are verified by their whole
sets. Every text sends 20 signatures, whatever the table's size. No pair is linked wrongly; pairs that share no partition's
value are missed (README has the recall by similarity).

Null text: as empty, with fingerprint zero, which links like any other; ``near_copies`` has no row for a text without words.
Very long texts: one row of a batch, whose words take some 100 bytes each while it is hashed. Repeated rows: one output row each.
Empty table: no rows. A component of null doc_ids only has a null component_id. Columns of docs are not kept but for those named in carry,
which go along in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontaminate import Words, slices
from .pigeonhole import agree, agreeing, ball, connecting_links, flipped, meetings, pairs_by_sets, pairs_inside, plan, with_share_of
from .shared import BLANK_SEPARATED, carried_schema, join_dealt, keyed_texts, mixed, placed_texts, scanned, written

WORDS_64, FAR_BITS = 10, 96
#: Up to so many rows' places are broadcast to find their texts (some 64 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def fingerprint(own: list[bytes], words: int = 3) -> int:
    """Of a text's words, as a signed 64-bit number: the majority, bit by bit, of the hashes of all shingles."""
    from xxhash import xxh64_digest

    if not own:
        return 0
    if len(own) <= words:
        parts = [b" ".join(own)]
    else:
        parts = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    hashes = b"".join([xxh64_digest(p, 42) for p in parts])
    n = len(hashes) // 8
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_000):
        part = np.frombuffer(hashes, dtype=np.uint8, offset=8 * at, count=8 * min(65_000, n - at))
        bits += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``rid, doc_id, n_words, fp``, and ``carried`` if columns go along."""
    texts = keyed_texts(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(2).to_pylist():
                own = text.encode().lower().split()
                fps.append(fingerprint(own, words))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), *batch.columns[3:]], names=["rid", "doc_id", "n_words", "fp", *batch.schema.names[3:]])

    return texts.mapInArrow(run, "rid long, doc_id long, n_words long, fp long" + carried_schema(texts))


def _differing(x: Column, y: Column, field: str, n_words: int) -> Column:
    return sum((F.bit_count(x[field][w].bitwiseXOR(y[field][w])) for w in range(n_words)), F.lit(0))


def _differing_arrays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of x differs from each of y."""
    out = np.zeros((len(x), len(y)), dtype=np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    return out


def within(max_bits: int, x: Column, y: Column, n_words: int = 1) -> Column:
    """Whether two nodes' fingerprints differ in at most max_bits bits."""
    return _differing(x, y, "f", n_words) <= max_bits


def links(fps: DataFrame, max_bits: int = 2, bucket_rows: int = 64, sample_rows: int = 2000) -> DataFrame:
    """``a, b``: links among distinct fingerprints (column fp) that connect all those within max_bits bits."""
    nodes = fps.select(F.col("fp").alias("node"), F.array("fp").alias("f"))
    parts = plan(nodes, 1, max_bits, sample_rows)
    if not parts:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    near = lambda x, y: within(max_bits, x, y)
    if max_bits != 2:
        return connecting_links(nodes, parts, near, bucket_rows)
    met = meetings(nodes, parts)
    shared = met.where(F.col("rows") > bucket_rows).select(F.col("x.node").alias("fp")).distinct()
    shared = shared.select("fp", F.explode(flipped(F.col("fp"), ball(list(range(64)), 1))).alias("value"))
    stars = shared.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b"))
    return pairs_inside(met, near, bucket_rows).select("a", "b").unionByName(stars).distinct()


def _grouped(nodes: DataFrame, found: DataFrame, least: Column) -> DataFrame:
    """``node, group, component_id``: the root that each node is connected with by the links, and the least value there."""
    n = nodes.count()
    roots = nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min(least).alias("component_id"), F.count("*").alias("weight"))
    return join_dealt(written(roots.select("node", "root", "weight_of_node")), names, "root", n).select("node", F.col("root").alias("group"), "component_id", F.col("weight_of_node").alias("weight"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, bucket_rows: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """``rid, doc_id, n_words, fp, group, component_id``, and ``carried`` if columns go along: the smallest fingerprint and doc_id that each document is connected with."""
    own = written(fingerprints(docs, words, carry))
    fps = written(own.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("weight_of_node")))
    named = _grouped(fps, links(fps.select(F.col("node").alias("fp")), max_bits, bucket_rows), F.col("least"))
    return join_dealt(own.withColumn("node", F.col("fp")), written(named), "node", own.count(), stored=True).select("rid", "doc_id", "n_words", "fp", "group", "component_id", *own.columns[4:])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS_64 words: for each bit the majority over the distinct hashes, each spread over all bits."""
    salts = mixed(np.arange(1, WORDS_64 + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    votes = np.zeros(64 * WORDS_64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(mixed(hashes[at : at + 4096, None] ^ salts).view(np.uint8), axis=1)
        # 255 rows of zeros and ones add up inside bytes, eight at a time.
        for i in range(0, len(bits), 255):
            votes += bits[i : i + 255].view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(votes * 2 > len(hashes)).view(np.int64)


def _shingle_sets(every: Words, words: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Place, first word, last word and distinct shingles of each text that has words; one of fewer words is one shingle."""
    runs, bounds = every.shingles(words), every.bounds.tolist()
    for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if e - s >= words:
            yield i, s, e, np.unique(runs[s : e - words + 1])
        elif e > s:
            yield i, s, e, Words([b" ".join(every.words(s, e - s))], BLANK_SEPARATED).shingles(e - s)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of shingles falls in each class. Two differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def profiles(docs: DataFrame, words: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``file, rid, doc_id, node, f, n, sketch`` of the texts with words; node: a hash of the set of shingles, n: its size."""
    texts = placed_texts(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        longs = pa.list_(pa.int64())
        for batch in batches:
            column = batch.column(3).cast(pa.binary()).to_pylist()
            for first, last in slices(column):
                every = Words(column[first:last], BLANK_SEPARATED)
                rows, nodes, fps, sizes, sketches = [], [], [], [], []
                for i, s, e, own in _shingle_sets(every, words):
                    rows.append(i)
                    nodes.append(xxh3_64_intdigest(own.tobytes()))
                    fps.append(wide_fingerprint(np.unique(every.hashes[s:e])))
                    sizes.append(len(own))
                    sketches.append(sketch(own))
                part = batch.slice(first, last - first).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(fps, longs), pa.array(sizes, pa.int32()), pa.array(sketches, longs), *part.columns[4:]],
                    names=["file", "rid", "doc_id", "node", "f", "n", "sketch", *part.schema.names[4:]],
                )

    return texts.mapInArrow(run, "file long, rid long, doc_id long, node long, f array<long>, n int, sketch array<long>" + carried_schema(texts))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, reach, shingles`` of the texts at the places ``file, rid`` of wanted."""
    few = wanted.count() <= BROADCAST_ROWS
    rows = placed_texts(docs).select("file", "rid", "text").join(F.broadcast(wanted) if few else wanted, ["file", "rid"]).select("node", "reach", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.binary()).to_pylist()
            for first, last in slices(column):
                sets = [own.view(np.int64) for _, _, _, own in _shingle_sets(Words(column[first:last], BLANK_SEPARATED), words)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "reach", "shingles"])

    return rows.mapInArrow(run, "node long, reach long, shingles array<long>")


def near_copies(docs: DataFrame, words: int = 5, bucket_rows: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """``file, rid, doc_id, group``, and ``carried`` if columns go along, of the texts with words: equal groups where links of a similarity of 0.8 or more connect."""
    docs = scanned(docs)
    own = written(profiles(docs, words, carry))
    nodes = written(own.groupBy("node").agg(F.min(F.struct("file", "rid")).alias("place"), *(F.first(c).alias(c) for c in ("f", "n", "sketch")), F.count("*").alias("weight_of_node")))

    def near(x: Column, y: Column) -> Column:
        # A similarity of 0.8 or more: the sets differ in at most a ninth of both sizes' sum.
        sizes = 5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"])
        return sizes & (9 * _differing(x, y, "sketch", 8) <= x["n"] + y["n"]) & within(FAR_BITS, x, y, WORDS_64)

    def close(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        n, m = x["n"].astype(np.int64)[:, None], y["n"].astype(np.int64)[None]
        sizes = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * _differing_arrays(x["sketch"], y["sketch"]).astype(np.int64) <= n + m)
        return sizes & (_differing_arrays(x["f"], y["f"]) <= FAR_BITS) & agreeing(parts, x["f"], y["f"])

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("a", "reach_a").union(pairs.select("b", "reach_b")).toDF("node", "reach").distinct()
        wanted = written(ends.join(nodes.select("node", "place.file", "place.rid"), "node"))
        sets = written(shingle_sets(docs, wanted, words))
        both = with_share_of(with_share_of(pairs, "a", sets, "shingles"), "b", sets, "shingles")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return both.where(9 * shared >= 4 * (F.size("shingles_a") + F.size("shingles_b"))).select("a", "b")

    def apart(rows: DataFrame) -> DataFrame:
        members = written(rows.groupBy(F.col("x.node").alias("node")).agg(F.first("root").alias("root"), F.first("x").alias("x")))
        wanted = written(members.select("node", "x.reach").join(nodes.select("node", "place.file", "place.rid"), "node"))
        return pairs_by_sets(members, shingle_sets(docs, wanted, words), lambda x, y: agree(parts, x, y) & near(x, y), close, bucket_rows)

    parts = plan(nodes, WORDS_64, 1)
    rest = own.columns[7:]
    if not parts:
        return own.select("file", "rid", "doc_id", F.col("node").alias("group"), *rest)
    linked = connecting_links(nodes.select("node", "f", "n", "sketch"), parts, near, bucket_rows, verified, apart)
    named = _grouped(nodes.select("node", "weight_of_node"), linked, F.col("node"))
    return join_dealt(own.select("file", "rid", "doc_id", "node", *rest), written(named), "node", own.count(), stored=True).select("file", "rid", "doc_id", "group", *rest)
