"""Hidden Markov language model (operator 4).

1. A pass counts the training tokens: combined in each task, then by a grouped sum over the whole vocabulary. A token is known by
   a hash of 64 bits.
2. Emissions are tied: the ``own_symbols`` most frequent tokens are symbols of their own; any other token's symbol is a class by
   its last bytes, inside which it has its share of the class's counts. own_symbols is a parameter of the model (README
   has its cost in likelihood), so what a round gathers is bounded. The model gives every token, known or not, a probability, and the
   probabilities of all tokens sum to one.
3. Texts are split into tokens once more and written as symbols; all that follows reads numbers.
4. Baum-Welch: each task runs scaled forward and backward recursions over its whole training texts and adds up expected
   counts; Spark sums them over all tasks (symbols x states numbers). Texts of more than ``SEGMENT`` tokens are cut for speed only:
   the products of a segment's matrices carry the forward and backward vectors over each cut, exactly.
5. Scoring: the same forward recursion over each whole text gives the exact likelihood of its symbols. What depends on
   infrequent tokens (their counts, for the base score and their share of a class) comes by a shuffled join with
   the vocabulary; frequent tokens are looked up in a broadcast table.

Null or empty text: its tokens are the end token alone. Very long texts: a text's symbols (4 bytes each) and segments'
matrices are in memory, never its whole recursion. Repeated rows: each counts and is scored. Rows with null doc_id
train and are scored as rows that are not held out. Ties of counts: tokens of one count are all symbols of their own or none is. Empty table: no rows. Other columns of docs don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import Words, slices
from .shared import BLANK_SEPARATED, head_threshold, keyed_texts, mixed, written

#: The end token's hash, and the classes of infrequent tokens.
END, CLASSES = 0, 512
#: Tokens of a segment, cells (tokens x segments, with padding) that one recursion holds, and tokens of texts taken together.
SEGMENT, CELLS, TOGETHER = 256, 1 << 18, 1 << 20


def _classes(words: Words) -> np.ndarray:
    """For each token a class by its last three bytes (or fewer)."""
    buf = np.frombuffer(words.raw, dtype=np.uint8).astype(np.uint64)
    tail = np.zeros(len(words.end), dtype=np.uint64)
    for back in (3, 2, 1):
        at = words.end - back
        inside = at >= words.start
        tail[inside] = tail[inside] << np.uint64(8) | buf[at[inside]]
    return (mixed(tail) % np.uint64(CLASSES)).astype(np.int32)


def count_tokens(texts: DataFrame, flush_at: int = 400_000) -> DataFrame:
    """``h, k, c``: hash, class and count of each distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        ends = size = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, k, c = (np.concatenate(x) for x in zip(*waiting, strict=True))
            found, first, where = np.unique(h, return_index=True, return_inverse=True)
            return found, k[first], np.bincount(where, c, len(found)).astype(np.int64)

        def batch_of(h: np.ndarray, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k, pa.int32()), pa.array(c, pa.int64())], names=["h", "k", "c"])

        for batch in batches:
            column = batch.column(0).cast(pa.binary()).to_pylist()
            ends += len(column)
            for a, b in slices(column):
                words = Words(column[a:b], BLANK_SEPARATED)
                found, first, c = np.unique(words.hashes, return_index=True, return_counts=True)
                waiting.append((found, _classes(words)[first], c))
                size += len(found)
                if size > flush_at:
                    waiting[:] = [merged()]
                    size = len(waiting[0][0])
                    if 2 * size > flush_at:
                        yield batch_of(*waiting.pop())
                        size = 0
        if waiting:
            yield batch_of(*merged())
        if ends:
            yield batch_of(np.array([END], dtype=np.uint64), np.array([0]), np.array([ends]))

    return texts.select("text").mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.first("k").alias("k"), F.sum("c").alias("c"))


class Model:
    """start (S), move (S x S), emit (symbols x S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, dtype: type = np.float32):
        self.start, self.move, self.emit = start.astype(dtype), move.astype(dtype), emit.astype(dtype)
        self._rows: np.ndarray | None = None

    def by_state(self) -> np.ndarray:
        """Emissions with a row for each state, made once in a process."""
        if self._rows is None:
            self._rows = np.ascontiguousarray(self.emit.T)
        return self._rows


def initial(symbol_counts: np.ndarray, states: int, seed: int = 3) -> Model:
    """Sticky states whose emissions are the counts, disturbed at random."""
    rng = np.random.default_rng(seed)
    emit = (symbol_counts[:, None] + 0.5) * rng.uniform(0.5, 1.5, (len(symbol_counts), states))
    move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0), np.float64)


class Segments:
    """Texts of symbols cut into segments, which the recursions take in groups of like length."""

    def __init__(self, texts: list[np.ndarray], longest: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-sizes // longest)
        self.flat = np.concatenate([np.zeros(0, dtype=np.int32), *texts])
        self.text = np.repeat(np.arange(len(texts)), pieces)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = (np.cumsum(sizes) - sizes)[self.text] + self.nth * longest
        self.size = np.minimum(longest, sizes[self.text] - self.nth * longest)
        self.cut = np.flatnonzero(self.nth > 0)  # segments that continue a text

    def groups(self, which: np.ndarray, cells: int) -> Iterator[np.ndarray]:
        """Segments in groups whose longest one times their number is at most about ``cells``; longest first in each."""
        which = which[np.argsort(self.size[which], kind="stable")]
        at = 0
        while at < len(which):
            # The group's last segment is its longest.
            fits = self.size[which[at:]] * np.arange(1, len(which) - at + 1) <= cells
            n = max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
            yield which[at : at + n][::-1]
            at += n

    def padded(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (time x segment), and how many segments are active at each time."""
        size = self.size[group]
        inside = np.arange(size[0])[None, :] < size[:, None]
        x = np.zeros(inside.shape, dtype=np.int32)
        x[inside] = self.flat[(self.start[group][:, None] + np.arange(size[0])[None, :])[inside]]
        return np.ascontiguousarray(x.T), inside.sum(0)


def _ends(model: Model, seg: Segments, which: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments that begin a text: the scaled forward vector after each, and log10 of its likelihood."""
    states, emit, move = len(model.start), model.by_state(), model.move.T
    out, logs = np.zeros((len(seg.size), states)), np.zeros(len(seg.size))
    for group in seg.groups(which, cells):
        x, active = seg.padded(group)
        # Vectors are columns: sums over states are sums of rows.
        alpha, total = np.zeros((states, len(group)), dtype=emit.dtype), np.zeros(len(group))
        for t in range(len(x)):
            k = active[t]
            a = emit.take(x[t, :k], axis=1)
            a *= move @ alpha[:, :k] if t else model.start[:, None]
            scale = a.sum(0)
            total[:k] += np.log10(scale, dtype=np.float64)
            np.divide(a, scale, out=alpha[:, :k])
        out[group], logs[group] = alpha.T, total
    return out, logs


def _products(model: Model, seg: Segments, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments that continue a text: the scaled product of their matrices (state before x state after), and log10 of its scale."""
    states, emit, move = len(model.start), model.by_state(), np.ascontiguousarray(model.move.T)
    out, logs = np.zeros((len(seg.size), states, states)), np.zeros(len(seg.size))
    for group in seg.groups(seg.cut, cells // states):
        x, active = seg.padded(group)
        m = np.repeat(np.eye(states, dtype=emit.dtype)[:, :, None], len(group), axis=2)
        total = np.zeros(len(group))
        for t in range(len(x)):
            k = active[t]
            a = move @ m[:, :, :k]
            a *= emit.take(x[t, :k], axis=1)
            scale = a.sum(0).sum(0)
            total[:k] += np.log10(scale, dtype=np.float64)
            np.divide(a, scale, out=m[:, :, :k])
        out[group], logs[group] = m.transpose(2, 0, 1), total
    return out, logs


def _carried(model: Model, seg: Segments, cells: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forward vector that each segment starts from (for those that continue a text), their products, and log10 of each text's likelihood.

    which: the first segments that count; those of texts that are cut must be among them.
    """
    ends, logs = _ends(model, seg, which, cells)
    products, more = _products(model, seg, cells) if len(seg.cut) else (ends, logs)
    before = np.zeros((len(seg.size), len(model.start)))
    for i in seg.cut:
        before[i] = ends[i - 1]
        after = before[i] @ products[i]
        total = after.sum()
        ends[i], logs[i] = after / total, more[i] + np.log10(total)
    return before, products, np.bincount(seg.text, logs) if len(logs) else np.zeros(0)


def forward(model: Model, texts: list[np.ndarray], longest: int = SEGMENT, cells: int = CELLS) -> np.ndarray:
    """log10 of the likelihood of each sequence of symbols (of one at least), exactly, by the scaled recursion."""
    seg = Segments(texts, longest)
    return _carried(model, seg, cells, np.flatnonzero(seg.nth == 0))[2]


def expected_counts(model: Model, texts: list[np.ndarray], emits: np.ndarray, longest: int = SEGMENT, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected starts and moves, and log10 of the likelihood of all; expected emissions are added to emits."""
    seg, states, emit, move = Segments(texts, longest), len(model.start), model.by_state(), np.ascontiguousarray(model.move.T)
    is_cut = np.zeros(len(seg.size), dtype=bool)
    if len(seg.cut):
        firsts = seg.cut[seg.nth[seg.cut] == 1] - 1
        before, products, logs = _carried(model, seg, cells, firsts)
        is_cut[seg.cut] = is_cut[firsts] = True
    # The backward vector after each segment.
    after = np.ones((len(seg.size), states))
    for i in seg.cut[::-1]:
        b = products[i] @ after[i]
        after[i - 1] = b / b.sum()
    starts, moves, likelihood = np.zeros(states), np.zeros((states, states)), float(logs.sum()) if len(seg.cut) else 0.0
    for group in seg.groups(np.arange(len(seg.size)), cells):
        x, active = seg.padded(group)
        begins = seg.nth[group] == 0
        came = before[group].T.astype(emit.dtype) if len(seg.cut) else None
        first = model.start[:, None] if came is None else np.where(begins, model.start[:, None], move @ came)
        alpha = np.zeros((len(x), states, len(group)), dtype=emit.dtype)
        shown, scale = np.zeros_like(alpha), np.ones(x.shape, dtype=emit.dtype)
        for t in range(len(x)):
            k = active[t]
            e = shown[t, :, :k] = emit.take(x[t, :k], axis=1)
            a = e * (move @ alpha[t - 1, :, :k] if t else first)
            scale[t, :k] = a.sum(0)
            np.divide(a, scale[t, :k], out=alpha[t, :, :k])
        likelihood += float(np.log10(scale[:, ~is_cut[group]], dtype=np.float64).sum())
        # Scaled so that forward times backward sums to one at the last token, and so at all.
        last = alpha[seg.size[group] - 1, :, np.arange(len(group))].T
        beta = after[group].T.astype(emit.dtype)
        beta /= (last * beta).sum(0)
        for t in range(len(x) - 1, -1, -1):
            k, later = active[t], active[t + 1] if t + 1 < len(x) else 0
            if later:
                ahead = shown[t + 1, :, :later] * beta[:, :later]
                ahead /= scale[t + 1, :later]
                moves += alpha[t, :, :later] @ ahead.T * model.move
                np.matmul(model.move, ahead, out=beta[:, :later])
            alpha[t, :, :k] *= beta[:, :k]
        if came is not None:
            ahead = shown[0] * beta / scale[0]
            moves += came[:, ~begins] @ ahead[:, ~begins].T * model.move
        starts += alpha[0][:, begins].sum(1)
        inside = np.arange(x.shape[1])[None, :] < active[:, None]
        flat = x[inside]
        for s in range(states):
            emits[:, s] += np.bincount(flat, alpha[:, s][inside], len(emits))
    return starts, moves, likelihood


def _in_turn(column: pa.Array, together: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Lists of symbols, some texts at a time, and the first one's place."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    at = 0
    while at < len(column):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + together, side="right")) - 1)
        until = min(until, len(column))
        yield at, [values[offsets[i] : offsets[i + 1]] for i in range(at, until)]
        at = until


def baum_welch(coded: DataFrame, model: Model, together: int = TOGETHER) -> tuple[Model, float]:
    """One round: expected counts of every task, summed by Spark, make the next model; also log10 of the likelihood under the given one."""
    n_symbols, states = model.emit.shape
    held = coded.sparkSession.sparkContext.broadcast(Model(model.start, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emits, starts, moves, likelihood = np.zeros((n_symbols, states)), np.zeros(states), np.zeros((states, states)), 0.0
        for batch in batches:
            for _, texts in _in_turn(batch.column(0), together):
                a, b, c = expected_counts(held.value, texts, emits)
                starts, moves, likelihood = starts + a, moves + b, likelihood + c
        seen = np.flatnonzero(emits.sum(1) > 0)
        rows = np.concatenate([emits[seen], moves, starts[None, :], np.full((1, states), likelihood)])
        keys = np.concatenate([seen, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[:, s], pa.float64()) for s in range(states))], names=["k", *(f"s{s}" for s in range(states))])

    schema = "k int, " + ", ".join(f"s{s} double" for s in range(states))
    summed = coded.select("symbols").mapInArrow(run, schema).groupBy("k").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas().to_numpy(dtype=np.float64)
    k, values = summed[:, 0].astype(np.int64), summed[:, 1:]
    emit, move, start = np.full((n_symbols, states), 0.01), np.full((states, states), 0.1), np.full(states, 0.1)
    emit[k[k >= 0]] += values[k >= 0]
    inner = (k < 0) & (k >= -states)
    move[-1 - k[inner]] += values[inner]
    start += values[k == -1 - states].sum(0)
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), np.float64), float(values[k == -2 - states, 0].sum())


_CODED = "rid long, doc_id long, train boolean, n_tokens long, known long, logs double, shares double, symbols array<int>, rare_h array<long>, rare_n array<int>"


def coded_texts(texts: DataFrame, head: np.ndarray, head_counts: np.ndarray, class_sums: np.ndarray, class_kinds: np.ndarray) -> DataFrame:
    """Each text's symbols, its infrequent tokens, and what the frequent ones (``head``, sorted hashes) and classes give to its scores."""
    # Inside its class a token has (c + 0.5) / (sums + 0.5 (kinds + 1)), where all unknown tokens share one place.
    held = texts.sparkSession.sparkContext.broadcast((head, head_counts, np.log10(class_sums + 0.5 * (class_kinds + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, class_logs = held.value
        n_head, end = len(hashes), int(np.searchsorted(hashes, np.uint64(END)))
        count_logs = np.log10(counts + 0.5)
        for batch in batches:
            column = batch.column(3).cast(pa.binary()).to_pylist()
            for a, b in slices(column):
                words, n = Words(column[a:b], BLANK_SEPARATED), b - a
                found, where = np.unique(words.hashes, return_inverse=True)
                at = np.searchsorted(hashes, found)
                at[at == n_head] = 0
                own = np.where(hashes[at] == found, at, -1).astype(np.int32)[where]
                rare = np.flatnonzero(own < 0)
                kinds = _classes(words)[rare]
                own[rare] = n_head + kinds
                text = words.text_of(np.arange(len(own)))
                # Each text's end token follows its words.
                bounds = words.bounds + np.arange(n + 1)
                symbols = np.full(len(own) + n, end, dtype=np.int32)
                symbols[np.arange(len(own)) + text] = own
                owner = np.repeat(np.arange(n), np.diff(bounds))
                frequent = symbols < n_head
                known = np.bincount(owner[frequent], counts[symbols[frequent]] > 0, n).astype(np.int64)
                logs = np.bincount(owner[frequent], count_logs[symbols[frequent]], n)
                shares = -np.bincount(text[rare], class_logs[kinds], n).astype(np.float64)
                # Distinct pairs of a text and an infrequent token; where: places in found, so the order is by text, then hash.
                pair, times = np.unique(text[rare] * len(found) + where[rare], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(n + 1) * len(found))
                part = batch.slice(a, n)
                lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(np.diff(bounds), pa.int64()), pa.array(known), pa.array(logs), pa.array(shares), lists(pa.array(symbols), bounds),
                        lists(pa.array(found[pair % max(1, len(found))].view(np.int64)), cuts), lists(pa.array(times, pa.int32()), cuts),
                    ],
                    names=[c.split()[0] for c in _CODED.split(", ")],
                )

    return texts.select("rid", "doc_id", "train", "text").mapInArrow(run, _CODED)


def score_texts(docs: DataFrame, train_on: Column, states: int = 8, rounds: int = 3, own_symbols: int = 1 << 16) -> DataFrame:
    """``rid, doc_id, n_tokens, n_known, train_tokens, base_score, score``; train_on: a condition on doc_id."""
    texts = keyed_texts(docs).withColumn("train", F.coalesce(train_on, F.lit(True)))
    vocabulary = written(count_tokens(texts.where("train")))
    least = head_threshold(vocabulary, "c", own_symbols)
    totals = vocabulary.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = totals["n"] or 0, totals["v"]
    frequent = (F.col("c") >= least) | (F.col("h") == END)
    # At most own_symbols rows; the end token is a symbol of its own, learned or not.
    rows = {END: 0} | {r["h"] & (1 << 64) - 1: r["c"] for r in vocabulary.where(frequent).select("h", "c").collect()}
    head = np.array(sorted(rows), dtype=np.uint64)
    head_counts = np.array([rows[h] for h in head.tolist()], dtype=np.float64)
    tail = vocabulary.where(~frequent)
    kinds, sums = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in tail.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("c").alias("sums")).collect():
        kinds[r["k"]], sums[r["k"]] = r["kinds"], r["sums"]
    coded = written(coded_texts(texts, head, head_counts, sums, kinds))
    model = initial(np.concatenate([head_counts, sums]), states)
    for _ in range(rounds):
        model, _ = baum_welch(coded.where("train"), model)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likelihoods = np.zeros(batch.num_rows)
            for at, own in _in_turn(batch.column(0), TOGETHER):
                likelihoods[at : at + len(own)] = forward(held.value, own)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(likelihoods)], names=[*batch.schema.names[1:], "forward"])

    numbers = ("rid", "doc_id", "n_tokens", "known", "logs", "shares")
    whole = coded.select("symbols", *numbers).mapInArrow(run, "rid long, doc_id long, n_tokens long, known long, logs double, shares double, forward double")
    whole = whole.select("rid", "doc_id", "n_tokens", "known", "logs", (F.col("shares") + F.col("forward")).alias("score"))
    rare = coded.select("rid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("t")).select("rid", F.col("t.rare_h").alias("h"), F.col("t.rare_n").alias("times"))
    seen = F.col("c").isNotNull()
    log = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    rare = rare.join(tail.select("h", "c"), "h", "left").select("rid", F.when(seen, F.col("times")).otherwise(0).cast("long").alias("known"), log.alias("logs"))
    parts = whole.unionByName(rare.withColumn("score", F.col("logs")), allowMissingColumns=True)
    out = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
    each = log10(n + 0.5 * (v + 1))
    return out.select("rid", "doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score")
