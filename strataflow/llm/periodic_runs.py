"""Periodic runs of words, found through minimizers of several scales.

A run is a longest stretch of words in which words a period apart are equal, of at least four of its smallest periods and six words. Periods up
to SHORT are found by comparing the words at each such distance. A longer period p belongs to the scale of the power of two k with
p <= k < 2p: k-word windows get hashes, and of any k/2 neighbouring ones the places of the least hash are minimizers. Within a run the
windows of two places p apart are equal, and so are their minimizers; four periods have room for both. As k words hold a whole
period, no place between them has an equal window. So neighbouring places among equal minimizers of a scale, more than k/2 and at most k
apart, hit every run of the scale. Each such seed is extended by comparing words, which also refutes chance hits.

Each document is taken whole, in a task; documents are put together to arrays of about WORDS words and need no shuffle. Numbers of words stand
for themselves exactly; windows are told apart by 64 bits of hash.

Null or empty text: no words, no runs. Null ids and repeated rows stay rows of their own. Of runs, ties of length go to the smallest start,
then period. Further columns are left out, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed

#: Periods that are found by direct comparison; a power of two.
SHORT = 4
#: Documents are taken together up to so many words.
WORDS = 1 << 18
LEAST, REPEATS = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lag_runs(x: np.ndarray, period: int) -> Runs:
    """Starts, ends and periods of the stretches of x that have a period."""
    same = np.zeros(max(0, len(x) - period) + 2, dtype=np.int8)
    same[1:-1] = x[period:] == x[:-period] if len(x) > period else 0
    step = np.diff(same)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + period
    long = end - start >= max(LEAST, REPEATS * period)
    return start[long], end[long], np.full(long.sum(), period)


def _sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over each width neighbouring values; width is a power of two."""
    span = 1
    while span < width:
        a = f(a[:-span], a[span:])
        span *= 2
    return a


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that have the least hash of any width neighbouring ones, all of equal ones."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    none = np.zeros(width - 1, dtype=np.uint64)
    least = np.concatenate([none, _sliding(np.minimum, hashes, width), none])
    return np.flatnonzero(_sliding(np.maximum, least, width) == hashes)


def seeds(hashes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(period, place) of neighbours among equal minimizers of a scale, in order."""
    at = minimizers(hashes, k // 2)
    own = hashes[at]
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    apart = np.diff(at)
    good = (own[1:] == own[:-1]) & (apart > k // 2) & (apart <= k)
    place, period = at[:-1][good], apart[good]
    order = np.lexsort((place, period))
    return list(zip(period[order].tolist(), place[order].tolist(), strict=True))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the left are equal."""
    at, step = 0, 32
    while at < len(a):
        unlike = a[at : at + step] != b[at : at + step]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at, step = at + len(unlike), 2 * step
    return len(a)


def extended(x: np.ndarray, found: list[tuple[int, int]]) -> Runs:
    """The runs around seeds, which are in order of period and place."""
    out, last, behind = [], 0, 0
    for period, at in found:
        if period == last and at < behind:
            continue
        ahead = at + _agree(x[at:-period], x[at + period :])
        start = at - _agree(x[:at][::-1], x[period : at + period][::-1])
        last, behind = period, ahead
        if ahead + period - start >= max(LEAST, REPEATS * period):
            out.append((start, ahead + period, period))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 3).T)


def runs(x: np.ndarray, lengths: np.ndarray) -> Runs:
    """Starts, ends and smallest periods, by start and period. x: documents of so many words, the longest first, a number that comes nowhere else behind each."""
    ends = np.cumsum(lengths + 1)
    found = [_lag_runs(x, p) for p in range(1, SHORT + 1)]
    hashes, k = mixed(x.view(np.uint64)), 1
    while True:
        # Only documents with four of the scale's least periods matter.
        n = int(np.searchsorted(-lengths, -REPEATS * (k // 2 + 1), side="right"))
        if k > SHORT and not n:
            break
        if k > SHORT:
            x, hashes = x[: ends[n - 1]], hashes[: ends[n - 1]]
            found.append(extended(x, seeds(hashes, k)))
        if len(hashes) <= k:
            break
        hashes = mixed(hashes[:-k] * _STEP + hashes[k:])
        k *= 2
    start, end, period = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # A stretch with a smaller period has its multiples, too, in the same bounds.
    own = np.ones(len(start), dtype=bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _together(docs: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in docs:
        held.append(words)
        size += len(words)
        if size >= WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def found_runs(docs: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and periods for each document's words."""
    lengths = np.array([len(w) for w in docs], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    numbers: dict[bytes, int] = {}
    fresh = count().__next__
    x = np.empty(int(lengths.sum()) + len(docs), dtype=np.int64)
    at, firsts = 0, np.zeros(len(docs), dtype=np.int64)
    for j, i in enumerate(order.tolist()):
        n = len(docs[i])
        x[at : at + n] = [numbers[w] if w in numbers else numbers.setdefault(w, fresh()) for w in docs[i]]
        x[at + n] = -1 - j
        firsts[j] = at
        at += n + 1
    start, end, period = runs(x, lengths[order])
    of = np.searchsorted(firsts, start, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(docs) + 1))
    out: list = [None] * len(docs)
    for j, i in enumerate(order.tolist()):
        own = slice(cuts[j], cuts[j + 1])
        out[i] = (start[own] - firsts[j], (end - start)[own], period[own])
    return out


def kept_words(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``: the runs of each text's words by start and period, and the text without repeats.

    change: what becomes of a document's words before (doc_id, words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0

            def texts(batch=batch, ids=ids):
                for i, text in zip(ids, batch.column(1), strict=True):
                    words = (text.as_py() or "").encode().split()
                    yield change(i, words) if change else words

            for group in _together(texts()):
                own = found_runs(group)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in zip(*(c.tolist() for c in r), strict=True)] for r in own]
                kept = [kept_words(w, *r) for w, r in zip(group, own, strict=True)]
                part = batch.column(0).slice(done, len(group))
                done += len(group)
                yield pa.RecordBatch.from_arrays([part, pa.array([len(w) for w in group], pa.int64()), pa.array(rows, _RUN_TYPE), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the CRC-32 of its id, with a stretch at its end that repeats a few times; others, and those without an id, as they are."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run, its exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    rows = found.withColumn("top", longest).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
