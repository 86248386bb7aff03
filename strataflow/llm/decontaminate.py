"""Benchmark decontamination by a prefix-filtered set join (operator 3).

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A window occurs in a
document only if all of its shingles (``shingle`` words) do, so one shingle is a sufficient prefix to join on.

1. Items become a table of distinct windows with their shingles and items; one pass over all documents counts how often each
   item shingle occurs. Each window's prefix is its rarest shingle, by a grouped minimum; windows with a shingle that no document has go.
2. A second pass looks up prefix shingles in each document. The place of a match fixes where the window would have to
   start (positional bound) and that it must end inside the document (length bound); what is left is compared
   word for word.

Items are dealt to blocks of at most ``block_bytes`` of text; each block's shingles and windows are broadcast as arrays and joined in passes of
their own, so what is broadcast doesn't grow with the benchmark. Nothing but counts and hits is shuffled.

Null texts and texts without words have no words and no hits; an item without words has no window; a null item_id is listed
as ``null``. Very long texts: one slice of a batch, whose words take some 100 bytes each. Items of equal text are each listed; repeated rows of a
document give one output row each. Empty tables: no rows, or rows without hits. Columns of docs are left out but for those named in carry,
which go along in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LETTERS_AND_DIGITS, carried_schema, keyed_texts, mixed, placed_texts, range_hashes, word_ranges, written

class Words:
    """The words of some texts, as ranges of one buffer of lower-cased bytes."""

    def __init__(self, texts: list[bytes], of_word: np.ndarray = LETTERS_AND_DIGITS):
        self.raw = b"\n".join(texts).lower()
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.start, self.end = word_ranges(buf, of_word)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))
        self.hashes = range_hashes(buf, self.start, self.end)
        self.last = np.repeat(self.bounds[1:], np.diff(self.bounds))  # for each word, where its text ends

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def shingles(self, size: int) -> np.ndarray:
        """Hashes of the shingles that start at each word, wherever their text ends."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[i : n + i]
        return mixed(out)

    def words(self, first: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.raw[s:e] for s, e in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))


class Lookup:
    """Which of many hashes are in a set, by a bit table and a binary search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.shift = np.uint64(64 - max(16, min(26, len(self.sorted).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[self.sorted >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes, and for each the place in the sorted set."""
        at = np.flatnonzero(self.bits[hashes >> self.shift])
        where = np.searchsorted(self.sorted, hashes[at])
        ok = where < len(self.sorted)
        ok[ok] = self.sorted[where[ok]] == hashes[at[ok]]
        return at[ok], where[ok]


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes of text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def windows_of(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``win, n, size, hashes, items``: each distinct window's words (joined by spaces), the hashes of its shingles of size words, and its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = Words([text])
                n = min(window, len(words.start))
                if not n:
                    continue
                size, every = min(shingle, n), words.words(0, len(words.start))
                hashes = np.lib.stride_tricks.sliding_window_view(words.shingles(size).view(np.int64), n - size + 1)
                wins = [b" ".join(every[at : at + n]) for at in range(len(hashes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wins, pa.binary()), pa.array([n] * len(wins), pa.int32()), pa.array([size] * len(wins), pa.int32()), pa.array(list(hashes), pa.list_(pa.int64())), pa.array([item_id] * len(wins), pa.string())],
                    names=["win", "n", "size", "hashes", "item_id"],
                )

    rows = items.mapInArrow(run, "win binary, n int, size int, hashes array<long>, item_id string")
    return rows.groupBy("win").agg(*(F.first(c).alias(c) for c in ("n", "size", "hashes")), F.array_sort(F.collect_set("item_id")).alias("items"))


def shingle_counts(texts: DataFrame, by_size: dict[int, np.ndarray]) -> DataFrame:
    """``size, h, occurs``: how often each of the given shingles (sorted hashes) occurs in all texts, if it does."""
    held = texts.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {size: Lookup(h) for size, h in held.value.items()}
        counts = {size: np.zeros(len(x.sorted), dtype=np.int64) for size, x in lookups.items()}
        for batch in batches:
            column = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in slices(column):
                words = Words(column[a:b])
                for size, lookup in lookups.items():
                    at, which = lookup.find(words.shingles(size))
                    counts[size] += np.bincount(which[at + size <= words.last[at]], minlength=len(lookup.sorted))
        for size, lookup in lookups.items():
            seen = counts[size] > 0
            yield pa.RecordBatch.from_arrays([pa.array([size] * int(seen.sum()), pa.int32()), pa.array(lookup.sorted[seen].view(np.int64)), pa.array(counts[size][seen])], names=["size", "h", "occurs"])

    return texts.select("text").mapInArrow(run, "size int, h long, occurs long").groupBy("size", "h").agg(F.sum("occurs").alias("occurs"))


class Prefixes:
    """The windows of a block by their prefix shingles of one size, as arrays."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        self.lookup, rows = Lookup(h), rows.take(pa.array(order))
        self.bounds = np.searchsorted(h[order], self.lookup.sorted, side="left")
        self.bounds = np.append(self.bounds, len(h))
        self.offset, self.n = rows.column("offset").to_numpy(), rows.column("n").to_numpy()
        self.win, self.items = rows.column("win").combine_chunks(), rows.column("items").combine_chunks()

    def hits(self, words: Words, size: int) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, first word, words, items) of each window that occurs."""
        at, which = self.lookup.find(words.shingles(size))
        n = self.bounds[which + 1] - self.bounds[which]
        at, text = np.repeat(at, n), np.repeat(words.text_of(at), n)
        target = np.repeat(self.bounds[which], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        start = at - self.offset[target]
        inside = (start >= words.bounds[text]) & (start + self.n[target] <= words.bounds[text + 1])
        for t, s, k in zip(text[inside].tolist(), start[inside].tolist(), target[inside].tolist(), strict=True):
            length = int(self.n[k])
            if b" ".join(words.words(s, length)) == self.win[k].as_py():
                yield t, s - int(words.bounds[t]), length, self.items[k].as_py()


def _block_hits(texts: DataFrame, items: DataFrame, window: int, shingle: int, with_text: bool) -> DataFrame:
    windows = written(windows_of(items, window, shingle))
    # At most as many shingles and windows as the block has words.
    shingles = windows.select("size", F.explode("hashes").alias("h")).distinct().toPandas()
    by_size = {int(size): np.sort(own["h"].to_numpy(dtype=np.int64).view(np.uint64)) for size, own in shingles.groupby("size")}
    counts = written(shingle_counts(texts, by_size))
    each = windows.select("win", "size", F.posexplode("hashes").alias("offset", "h")).join(counts, ["size", "h"], "left")
    rarest = each.groupBy("win").agg(F.min(F.struct(F.coalesce("occurs", F.lit(0)).alias("occurs"), "offset", "h")).alias("r")).where(F.col("r.occurs") > 0)
    prefixes = windows.join(rarest, "win").select("win", "n", "size", "items", "r.offset", "r.h").toArrow()
    held = texts.sparkSession.sparkContext.broadcast(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held.value.column("size").to_numpy()
        tables = {int(size): Prefixes(held.value.filter(pa.array(sizes == size))) for size in np.unique(sizes)}
        for batch in batches:
            where = batch.schema.get_field_index("text")
            column = batch.column(where).cast(pa.binary()).to_pylist()
            for a, b in slices(column):
                words = Words(column[a:b])
                starts, ends, found = ([[] for _ in range(b - a)], [[] for _ in range(b - a)], [set() for _ in range(b - a)])
                for size, table in tables.items():
                    for doc, start, n, ids in table.hits(words, size):
                        starts[doc].append(start)
                        ends[doc].append(start + n)
                        found[doc].update(ids)
                part, ints = batch.slice(a, b - a), pa.list_(pa.int32())
                made = [pa.array(np.diff(words.bounds), pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                rest = where if with_text else where + 1
                yield pa.RecordBatch.from_arrays([*part.columns[:where], *made, *part.columns[rest:]], names=[*part.schema.names[:where], "n_words", "starts", "ends", "items", *part.schema.names[rest:]])

    keys = "file long, " if "file" in texts.columns else ""
    return texts.mapInArrow(run, f"{keys}rid long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>" + (", text string" if with_text else "") + carried_schema(texts))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = 4 << 20, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``rid, doc_id, n_words, n_hit, items``, ``text`` (a null one is empty) if asked for, and ``carried`` if columns go along: the words inside benchmark windows and the items (as strings, sorted) they are of."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    # The passes of several blocks meet again by file and row.
    texts = keyed_texts(docs, carry) if n_blocks == 1 else placed_texts(docs, carry)
    hits = None
    for block in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        part = _block_hits(texts, own, window, shingle, with_text)
        hits = part if hits is None else hits.unionByName(part)
    rest = [*(["text"] if with_text else []), *(["carried"] if carry else [])]
    if n_blocks > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")]
        hits = hits.groupBy("file", "rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), *(F.first(c).alias(c) for c in rest))
    # Words covered: in order of their starts, each range adds what reaches beyond the furthest end so far.
    ranges = F.array_sort(F.arrays_zip("starts", "ends"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["ends"] - F.greatest(r["starts"], s["far"]))).alias("n"), F.greatest(s["far"], r["ends"]).alias("far"))
    covered = F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")), step, lambda s: s["n"])
    return hits.select("rid", "doc_id", "n_words", covered.cast("long").alias("n_hit"), "items", *rest)
