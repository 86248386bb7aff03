"""Removal of repeated byte strings by longest-previous-factor arrays (operator 7).

A byte goes if a string of ``length`` bytes over it also starts earlier. Each such string (a window) has an anchor: the least
hash among its ``gram``-byte strings, leftmost if equal. Equal windows have equal anchors at equal places, so only windows
of equal anchors can be equal.

1. A pass gives the anchors (about one each 30 bytes). A grouped count tells those that occur again. While they are at most a
   quarter of ``2 ** table_bits`` they set bits of a table of that size, which is broadcast; beyond it each text's repeated
   anchors come to it by shuffled joins instead, so that what is sent below doesn't grow with full tables.
2. A second pass sends, for each such anchor, its run of windows as one string of context. A context that the task has seen
   before is settled there; only the earliest goes on. An anchor that occurs more than ``hot_rows`` times sends its
   windows one by one, keyed by their own content, so that no key gathers many different contexts.
3. Rows of a key meet, earliest first. Equal contexts are settled at once. Over the others' windows a suffix order is built
   and, from each place's previous and next smaller positions in it, the lengths of the longest previous factors, capped at
   ``length``: one reaches ``length`` exactly where the window also starts earlier.
4. Removed ranges go back to their documents.

"Earlier" is by doc_id, then file and row, then start; null doc_ids come first. Null text: empty. Very long texts: taken in pieces of
``PIECE`` bytes that overlap by length - 1, so of any size. Repeated rows: the later ones are copies. Texts under ``length`` bytes lose
nothing. Empty table: no rows. Columns of docs other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_dealt, placed_texts, range_hashes, written

#: Bytes of text that are taken together (some 60 bytes of memory each), and bits of a place in them.
PIECE, _AT_BITS = 1 << 20, 23


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the joined texts: each run's anchor hash, text, first window and last window (places in the joined bytes)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(buf) - length + 1
    if len(buf) > 1 << _AT_BITS:
        raise ValueError("more bytes than places have bits")
    if n <= 0:
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    at = np.arange(len(buf) - gram + 1)
    h = range_hashes(buf, at, at + gram)
    low = np.uint64((1 << _AT_BITS) - 1)
    least = (h & ~low) | at.astype(np.uint64)
    # The least of each span of (length - gram + 1) grams, by doubling.
    span, done = length - gram + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: n + 0], least[span - done : span - done + n])
    anchor = (least[:n] & low).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + length <= ends[text]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last_of = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return h[anchor[first]], text[first], first, last_of


def _pieces(texts: list[bytes], length: int, limit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, and pieces of those longer than limit, about limit bytes together: row, first byte, bytes. Each window is in one piece."""
    rows, bases, own, size = [], [], [], 0
    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - length + 1), limit):
            piece = text if len(text) <= limit else text[base : base + limit + length - 1]
            rows.append(i)
            bases.append(base)
            own.append(piece)
            size += len(piece)
            if size >= limit:
                yield rows, bases, own
                rows, bases, own, size = [], [], [], 0
            if piece is text:
                break
    if own:
        yield rows, bases, own


def anchor_counts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``h, n`` of the anchors that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in _pieces(batch.column(0).cast(pa.binary()).to_pylist(), length, PIECE):
                h, n = np.unique(anchor_runs(part, length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2 ** bits bits, those set that the hashes' low bits name; its parts of 4 KB are made in Spark."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(4096, 1 << (bits - 3)), dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out[: 1 << (bits - 3)]


def with_repeated_anchors(texts: DataFrame, counts: DataFrame, hot_rows: int, length: int, gram: int) -> DataFrame:
    """texts with ``again array<struct<first, hot>>``: where the runs of their repeated anchors begin, by shuffled joins."""
    names = ["file", "rid", "h", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, bases, part in _pieces(batch.column(2).cast(pa.binary()).to_pylist(), length, PIECE):
                h, text, first, _ = anchor_runs(part, length, gram)
                row = np.array(rows)[text]
                start = first - _starts(part)[text] + np.array(bases)[text]
                yield pa.RecordBatch.from_arrays([pa.array(files[row]), pa.array(rids[row]), pa.array(h.view(np.int64)), pa.array(start)], names=names)

    found = texts.select("file", "rid", "text").mapInArrow(run, "file long, rid long, h long, first long")
    total = counts.agg(F.sum("n")).first()[0] or 0
    table = counts.select("h", (F.col("n") > hot_rows).alias("hot"), F.col("n").alias("weight"))
    lists = join_dealt(found, table, "h", total).groupBy("file", "rid").agg(F.collect_list(F.struct("first", "hot")).alias("again"))
    return texts.join(lists.hint("shuffle_hash"), ["file", "rid"], "left")


def _starts(part: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)))])


def _is_set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(table) - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """The last place before each with a smaller value, or -1; by jumping over what is already known not to be smaller."""
    at, padded = np.arange(len(values)) - 1, np.append(values, np.iinfo(values.dtype).min)  # place -1 is the end
    open_ = np.flatnonzero(padded[at] >= values)
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[padded[at[open_]] >= values[open_]]
    return at


def longest_previous_factors(group: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For suffixes (rows of their first bytes, in text order): how many bytes each shares, at most, with one before it in its group.

    In the order of the groups and suffixes that is the longest common prefix with the nearest smaller position on either side.
    """
    n, length = suffixes.shape
    words = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    words[:, :length] = suffixes
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort([words[:, i] for i in range(words.shape[1] - 1, -1, -1)] + [group])
    by_group, sorted_words = group[order], words[order]
    out = np.zeros(n, dtype=np.int64)
    nsv = n - 1 - previous_smaller(order[::-1])[::-1]
    for near in (previous_smaller(order), nsv):
        at = np.flatnonzero((near >= 0) & (near < n))
        at = at[by_group[near[at]] == by_group[at]]
        apart = sorted_words[near[at]] ^ sorted_words[at]
        first = np.argmax(apart != 0, axis=1)  # the first word that differs
        x = apart[np.arange(len(at)), first]
        # Of a word that differs in its k-th byte, k - 1 bytes are shared.
        shared = 8 * first + sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[at] = np.maximum(out[at], np.where(x == 0, length, np.minimum(shared, length)))
    lengths = np.empty(n, dtype=np.int64)
    lengths[order] = out
    return lengths


_SENT = "key long, doc long, file long, rid long, start long, context binary, end long"
_RANGE = "file long, rid long, lo long, hi long"


def removed_ranges(texts: DataFrame, length: int = 100, gram: int = 32, hot_rows: int = 2000, table_bits: int = 28, seen_rows: int = 300_000, chunk_windows: int = 100_000) -> DataFrame:
    """``file, rid, lo, hi``: ranges of bytes of each row that go; they may overlap."""
    counts = written(anchor_counts(texts, length, gram))
    spark, hot_bits = texts.sparkSession, min(24, table_bits)
    few = counts.count() <= 1 << (table_bits - 2) and counts.where(F.col("n") > hot_rows).count() <= 1 << (hot_bits - 2)
    if few:
        tables = spark.sparkContext.broadcast((bit_table(counts, table_bits), bit_table(counts.where(F.col("n") > hot_rows), hot_bits)))
    else:
        texts = with_repeated_anchors(texts, counts, hot_rows, length, gram)
    low = -(1 << 63)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: dict[bytes, tuple[int, ...]] = {}  # by digests of 128 bits
        for batch in batches:
            files, rids, docs = (batch.column(i).to_pylist() for i in range(3))
            for rows, bases, part in _pieces(batch.column(3).cast(pa.binary()).to_pylist(), length, PIECE):
                h, text, first, last = anchor_runs(part, length, gram)
                starts = _starts(part)
                if few:
                    again, hot = tables.value
                    use = _is_set(again, h)
                    is_hot = _is_set(hot, h)
                else:
                    use, is_hot = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
                    for t, (row, base) in enumerate(zip(rows, bases, strict=True)):
                        a, b = np.searchsorted(text, [t, t + 1])
                        known = {x["first"]: x["hot"] for x in batch.column(4)[row].as_py() or () if base <= x["first"] < base + len(part[t])}
                        for i in range(a, b):
                            found = known.get(int(first[i]) - int(starts[t]) + base)
                            use[i], is_hot[i] = found is not None, bool(found)
                h, text, first, last, is_hot = h[use], text[use], first[use], last[use], is_hot[use]
                joined = b"".join(part)
                if is_hot.any():
                    # Each window of a hot run stands for itself.
                    n = np.where(is_hot, last - first + 1, 1)
                    each = np.repeat(np.arange(len(h)), n)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    one = is_hot[each]
                    h, text, first, last = h[each], text[each], first[each] + step, np.where(one, first[each] + step, last[each])
                    h[one] = range_hashes(np.frombuffer(joined, dtype=np.uint8), first[one], first[one] + length)
                places = (first - starts[text] + np.array(bases, dtype=np.int64)[text]).tolist()
                cols: tuple[list, ...] = ([], [], [], [], [], [], [])

                def add(row: tuple, cols=cols) -> None:
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)

                settled: list[int] = []  # file, rid, start and end of a range that goes and may still grow
                for key, t, f, e, at in zip(h.view(np.int64).tolist(), text.tolist(), first.tolist(), (last + length).tolist(), places, strict=True):
                    row = rows[t]
                    me, context = (low if docs[row] is None else docs[row], files[row], rids[row], at), joined[f:e]
                    digest = xxh3_128_digest(context)
                    known = seen.get(digest)
                    if known is None or known > me:
                        if len(seen) >= seen_rows:
                            seen.clear()
                        seen[digest] = me
                        add((key, *me, context, None))
                    elif settled and settled[:2] == [me[1], me[2]] and settled[2] <= at <= settled[3]:
                        settled[3] = max(settled[3], at + e - f)
                    else:
                        if settled:
                            add((None, None, *settled[:3], None, settled[3]))
                        settled = [me[1], me[2], at, at + e - f]
                if settled:
                    add((None, None, *settled[:3], None, settled[3]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary(), pa.int64()], strict=True)], names=["key", "doc", "file", "rid", "start", "context", "end"])

    # Rows without a key are ranges that are settled already; they only pass through.
    sent = texts.select("file", "rid", "doc_id", "text", *([] if few else ["again"])).mapInArrow(contexts, _SENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        key, group, waiting, n_windows = None, -1, [], 0
        distinct: set[bytes] = set()
        own: list = []

        def mark(file: int, rid: int, lo: int, hi: int) -> None:
            for c, x in zip(out, (file, rid, lo, hi), strict=True):
                c.append(x)

        def take() -> None:
            if not waiting:
                return
            counts = np.array([len(w[4]) - length + 1 for w in waiting])
            flat = np.frombuffer(b"".join(w[4] for w in waiting), dtype=np.uint8)
            starts = np.cumsum([0] + [len(w[4]) for w in waiting[:-1]])
            row = np.repeat(np.arange(len(waiting)), counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            windows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[row] + step]
            flags = longest_previous_factors(np.array([w[0] for w in waiting])[row], windows) >= length
            edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
            # Runs of repeated windows, cut where a new context begins.
            begins = np.flatnonzero((edge[:-1] == 1) | (flags & (step == 0)))
            finish = np.flatnonzero((edge[1:] == -1) | (flags & (step == counts[row] - 1)))
            for b, e in zip(begins.tolist(), finish.tolist(), strict=True):
                w = waiting[row[b]]
                mark(w[1], w[2], w[3] + int(step[b]), w[3] + int(step[e]) + length)
            waiting.clear()

        def flush() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["file", "rid", "lo", "hi"])
            for c in out:
                c.clear()
            return r

        def close() -> None:
            """The key is complete: its contexts need comparing if there are several."""
            nonlocal n_windows
            if len(own) > 1:
                waiting.extend(own)
                n_windows += sum(len(w[4]) - length + 1 for w in own)
                if n_windows > chunk_windows:
                    take()
                    n_windows = 0
            own.clear()
            distinct.clear()

        for batch in batches:
            for k, file, rid, start, context, end in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "rid", "start", "context", "end")), strict=True):
                if k is None:
                    mark(file, rid, start, end)
                    continue
                if k != key:
                    close()
                    key, group = k, group + 1
                if context in distinct:
                    mark(file, rid, start, start + len(context))
                else:
                    distinct.add(context)
                    own.append((group, file, rid, start, context))
            yield flush()
        close()
        take()
        yield flush()

    meeting = sent.repartition(F.coalesce("key", "rid")).sortWithinPartitions("key", "doc", "file", "rid", "start")
    return meeting.mapInArrow(compare, _RANGE)


def substring_dedup(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """``rid, doc_id, n_bytes, n_removed, n_spans, kept binary``."""
    texts = placed_texts(docs)
    ranges = removed_ranges(texts, length, **options).groupBy("file", "rid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    lows, highs = F.transform("ranges", lambda r: r["lo"]), F.transform("ranges", lambda r: r["hi"])
    joined = texts.join(ranges.select("file", "rid", lows.alias("lows"), highs.alias("highs")).hint("shuffle_hash"), ["file", "rid"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, removed, spans, kept = [], [], [], []
                for text, lo, hi in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    parts, gone, n, far = [], 0, 0, 0
                    open_ = None  # the end of the span so far
                    for a, b in zip(lo or (), hi or (), strict=True):
                        if open_ is None or a > open_:
                            n += 1
                            parts.append(text[far:a])
                            gone += b - a
                            far = open_ = b
                        elif b > open_:
                            gone += b - open_
                            far = open_ = b
                    parts.append(text[far:])
                    sizes.append(len(text))
                    removed.append(gone)
                    spans.append(n)
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("rid", "doc_id", "text", "lows", "highs").mapInArrow(cut, "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
