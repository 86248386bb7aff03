"""Line dedup through a sharded minimal perfect hash (operator 8).

1. Each document gives the hashes (128 bits) of its distinct long line keys; a grouped count and maximum, combined
   before the shuffle, keep the keys found in at least ``min_docs`` documents.
2. The kept hashes are dealt to shards. Each shard builds a minimal perfect hash (bit levels, each taking the keys
   that alone hit their bit) and arrays of 64-bit fingerprints, counts and last documents in its order.
3. Documents probe the arrays, which are broadcast while they stay below ``broadcast_bytes``. Beyond it, the probes
   (hashes, not lines) go to the shards: rows of a shard are dealt over ``salts`` tasks, each with a copy of its
   arrays, and stream past them.

A document is a row; a null text is one empty line; a repeated row counts as one more document.
Ties: lines of equal key in the largest doc_id all stay; a null doc_id is smaller than any other. Very long texts: a text and its lines are in
memory together, one batch of at most 1000 texts. Empty table: no rows. Columns of docs are left out but for those named in carry, which go along in
one struct, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, carried_schema, keyed_texts, mixed, placed_texts, written

STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_NO_DOC = -(1 << 63)


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER) if not line.isascii() else line.strip(STRIP).lower()


def _hash(key: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key.encode())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place at a level; both halves count, so that keys which agree in one part at some level."""
    step = np.uint64(level * 0x9E3779B9)
    return (mixed(h2.view(np.uint64) + step ^ mixed(h1.view(np.uint64) + step)) % np.uint64(size)).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray, gamma: float = 1.6) -> dict[str, np.ndarray]:
    """Arrays of a minimal perfect hash over distinct keys (two halves) and of what it indexes."""
    left, levels, sizes = np.arange(len(h1)), [], []
    while len(left):
        if len(sizes) > 200:
            raise ValueError("keys that repeat have no perfect hash")
        size = max(64, int(gamma * len(left)) + 63 & ~63)
        at = _slots(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = left[~alone[at]]
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    shard = {"sizes": np.array(sizes, dtype=np.int64), "bits": np.packbits(bits), "n_bits": np.array([len(bits)])}
    order = np.empty(len(h1), dtype=np.int64)
    order[shard_index(shard, h1, h2)] = np.arange(len(h1))
    return shard | {"prints": h1[order], "counts": counts[order], "last": last[order]}


def shard_index(shard: dict[str, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The place of each key; -1 for some, and any place for others, of the keys that aren't in the shard."""
    if "ranks" not in shard:
        shard["flat"] = np.unpackbits(shard["bits"], count=int(shard["n_bits"][0])).astype(bool)
        shard["ranks"] = np.cumsum(shard["flat"], dtype=np.int64) - 1
    out, open_, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(shard["sizes"].tolist()):
        at = base + _slots(h1[open_], h2[open_], level, size)
        hit = shard["flat"][at]
        out[open_[hit]] = shard["ranks"][at[hit]]
        open_, base = open_[~hit], base + size
    return out


def probe(shards: dict[int, dict[str, np.ndarray]], n_shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The last document of each probed key, or the smallest number for a key that isn't kept."""
    out = np.full(len(h1), _NO_DOC, dtype=np.int64)
    own = (h1.view(np.uint64) % np.uint64(n_shards)).astype(np.int64)
    for s in np.unique(own).tolist():
        if s not in shards:
            continue
        rows = np.flatnonzero(own == s)
        at = shard_index(shards[s], h1[rows], h2[rows])
        found = at >= 0
        found[found] = shards[s]["prints"][at[found]] == h1[rows[found]]
        out[rows[found]] = shards[s]["last"][at[found]]
    return out


def packed(shard: dict[str, np.ndarray]) -> bytes:
    f = io.BytesIO()
    np.savez(f, **{k: v for k, v in shard.items() if k not in ("flat", "ranks")})
    return f.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return dict(f)


def frequent_keys(texts: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``h1, h2, n, last``: hashes of the keys that at least min_docs documents hold, and the largest such doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids = [], [], []
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for key in {k for line in text.split("\n") if len(line) >= min_chars and len(k := line_key(line)) >= min_chars}:
                    a, b = _hash(key)
                    h1.append(a)
                    h2.append(b)
                    ids.append(_NO_DOC + 1 if doc_id is None else doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, ids)], names=["h1", "h2", "doc"])

    keys = texts.mapInArrow(run, "h1 long, h2 long, doc long")
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keys_per_shard: int = 50_000, broadcast_bytes: int = BROADCAST_BYTES, salts: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``, and ``carried`` if columns go along: the text without lines that recur, but for those of each key's last document."""
    texts = keyed_texts(docs, carry)
    keys = written(frequent_keys(texts, min_chars, min_docs))
    n_keys = keys.count()
    n_shards = max(1, -(-n_keys // keys_per_shard))

    def build(group: pa.Table) -> pa.Table:
        h1, h2, n, last = (group.column(c).to_numpy() for c in ("h1", "h2", "n", "last"))
        shard = build_shard(h1, h2, np.minimum(n, 2**31 - 1).astype(np.int32), last)
        return pa.table({"shard": pa.array([int(group.column("shard")[0].as_py())], pa.int32()), "arrays": pa.array([packed(shard)], pa.binary())})

    shard_of = _shard_column("h1", n_shards)
    shards = keys.withColumn("shard", shard_of).groupBy("shard").applyInArrow(build, "shard int, arrays binary")
    if n_keys * 24 <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["arrays"] for r in shards.collect()})
        return _drop_lines(texts, min_chars, lambda: _Held(held.value, n_shards))
    return _drop_routed(placed_texts(docs, carry), written(shards), n_shards, min_chars, salts)


def _shard_column(name: str, n_shards: int):
    """h1, taken as unsigned, modulo the number of shards."""
    high = F.shiftrightunsigned(F.col(name), 32)
    low = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))
    return (((high % n_shards) * ((1 << 32) % n_shards) + low) % n_shards).cast("int")


class _Held:
    """All shards, unpacked once in a task."""

    def __init__(self, arrays: dict[int, bytes], n_shards: int):
        self.shards, self.n_shards = {s: unpacked(a) for s, a in arrays.items()}, n_shards

    def last(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return probe(self.shards, self.n_shards, h1, h2)


def _lines(texts: list[str], min_chars: int) -> tuple[list[list[str]], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The lines of each text, and (text, line) with the hashes of those that are long enough."""
    split, at, h1, h2 = [], [], [], []
    for i, text in enumerate(texts):
        lines = text.split("\n")
        split.append(lines)
        for j, line in enumerate(lines):
            if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                a, b = _hash(key)
                at.append((i, j))
                h1.append(a)
                h2.append(b)
    return split, at, np.array(h1, dtype=np.int64), np.array(h2, dtype=np.int64)


_OUT = "doc_id long, n_lines long, n_dropped long, kept string"


def _kept(ids: list, split: list[list[str]], drop: list[set[int]], carried: list[pa.Array]) -> pa.RecordBatch:
    kept = ["\n".join(line for j, line in enumerate(lines) if j not in d) if d else "\n".join(lines) for lines, d in zip(split, drop, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(x) for x in split], pa.int64()), pa.array([len(d) for d in drop], pa.int64()), pa.array(kept, pa.string()), *carried],
        names=["doc_id", "n_lines", "n_dropped", "kept", *["carried"] * len(carried)],
    )


def _drop_lines(texts: DataFrame, min_chars: int, held) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = batch.column(1).to_pylist()
                split, at, h1, h2 = _lines(batch.column(2).to_pylist(), min_chars)
                drop: list[set[int]] = [set() for _ in ids]
                last = index.last(h1, h2)
                for k in np.flatnonzero(last != _NO_DOC).tolist():
                    i, j = at[k]
                    if last[k] != (_NO_DOC + 1 if ids[i] is None else ids[i]):
                        drop[i].add(j)
                yield _kept(ids, split, drop, batch.columns[3:])

    return texts.mapInArrow(run, _OUT + carried_schema(texts))


def _drop_routed(texts: DataFrame, shards: DataFrame, n_shards: int, min_chars: int, salts: int) -> DataFrame:
    """The same where the arrays are too large to broadcast: line hashes go to the shards and dropped lines come back."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rids, ids = (batch.column(i).to_pylist() for i in range(3))
            _, at, h1, h2 = _lines(batch.column(3).to_pylist(), min_chars)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[i] for i, _ in at], pa.int64()) for x in (files, rids)), pa.array([_NO_DOC + 1 if ids[i] is None else ids[i] for i, _ in at], pa.int64()), pa.array([j for _, j in at], pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["file", "rid", "doc", "line", "h1", "h2"],
            )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            kinds, own, arrays = batch.column("kind").to_numpy(), batch.column("shard").to_numpy(), batch.column("arrays")
            for i in np.flatnonzero(kinds == 0).tolist():
                held[int(own[i])] = unpacked(arrays[i].as_py())
            rows = batch.filter(pa.array(kinds == 1))
            h1, h2, doc = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            last = probe(held, n_shards, h1, h2)
            hit = pa.array((last != _NO_DOC) & (last != doc))
            yield rows.select(["file", "rid", "line"]).filter(hit)
            newest = int(own[-1]) if len(own) else -1
            held = {k: v for k, v in held.items() if k >= newest}

    sent = texts.mapInArrow(probes, "file long, rid long, doc long, line int, h1 long, h2 long")
    salt = F.pmod(F.col("rid") + F.col("file"), F.lit(salts)).cast("int").alias("salt")
    sent = sent.select(F.lit(1).alias("kind"), _shard_column("h1", n_shards).alias("shard"), salt, "file", "rid", "doc", "line", "h1", "h2", F.lit(None).cast("binary").alias("arrays"))
    empty = (("file", "long"), ("rid", "long"), ("doc", "long"), ("line", "int"), ("h1", "long"), ("h2", "long"))
    copies = shards.select(F.lit(0).alias("kind"), "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *(F.lit(None).cast(t).alias(c) for c, t in empty), "arrays")
    dropped = sent.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(stream, "file long, rid long, line int")
    dropped = dropped.groupBy("file", "rid").agg(F.collect_set("line").alias("lines"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept(batch.column(1).to_pylist(), [t.split("\n") for t in batch.column(2).to_pylist()], [set(x or ()) for x in batch.column(3).to_pylist()], batch.columns[4:])

    return texts.join(dropped, ["file", "rid"], "left").select("rid", "doc_id", "text", "lines", *texts.columns[4:]).mapInArrow(rebuild, _OUT + carried_schema(texts))
