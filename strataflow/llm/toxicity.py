"""Toxicity by a factorization machine over hashed terms (operator 1).

Terms of a text: its words and their first 4 and 5 bytes (which catch inflected and compound forms), hashed to 2**24
places. A document has a term or hasn't. Score: sigmoid(bias + sum of w + sum over pairs of <v_i, v_j>), the pairs by
the usual identity in time linear in the terms; a pair, such as an insult with a group's name, can weigh more or less than
its two parts.

Training takes at most about ``sample_rows`` labelled documents, drawn by a hash of doc_id; the sample is a documented
parameter. Spark counts the terms of the sample. The machine has the ``terms`` that tell the labels apart best by themselves, and of the
``frequent`` ones that most documents have those that tell them apart in a pair, though they may say nothing alone. It is fitted
on this bounded sample (rows x kept terms). Every whole text is then scored in one pass without a shuffle.

Null or empty text: no terms, so the score is that of the bias alone, which is the share of toxic labels. Without
labels of both kinds every score is the share of toxic labels (0 if there are none). Several labels of one document: toxic
if any is. Null labels and labels of null ids are left out. Very long texts: one slice of a batch, whose words take some 100 bytes
each. Repeated rows: one output row each. Rows of null ids are scored. Empty table: no rows. Columns of docs are left out but for those
named in carry, which go along in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import Words, slices
from .shared import carried_schema, keyed_texts, range_hashes, written

PLACES = 24
PREFIXES = (4, 5)


def term_places(words: Words) -> np.ndarray:
    """A row for each kind of term, a column for each word."""
    buf = np.frombuffer(words.raw, dtype=np.uint8)
    kinds = [words.hashes]
    for n in PREFIXES:
        cut = np.minimum(words.start + n, words.end)
        kinds.append(range_hashes(buf, words.start, cut) ^ np.uint64(n))
    return (np.stack(kinds) >> np.uint64(64 - PLACES)).astype(np.int64)


@dataclass
class Machine:
    places: np.ndarray  # sorted places of the kept terms
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """doc, term: distinct pairs of a document and a kept term."""
        out = np.full(n_docs, self.bias) + np.bincount(doc, self.w[term], n_docs)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(doc, x, n_docs) ** 2 - np.bincount(doc, x * x, n_docs))
        return out


def fit(x: np.ndarray, y: np.ndarray, places: np.ndarray, factors: int, epochs: int, decay: float, seed: int = 7) -> Machine:
    """Adam on the logistic loss over a dense 0/1 matrix of the sample."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(d), rng.normal(0, 0.02, (d, factors))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, epochs + 1):
        bias, w, v = params
        xv = x @ v
        margin = bias + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        xg = x.T @ g
        grads = [np.array([g.sum()]), xg + decay * w, x.T @ (xv * g[:, None]) - v * xg[:, None] + decay * v]
        rate = 0.05 * (1 - 0.9 * step / epochs)
        for p, m, grad in zip(params, moments, grads, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.999 * m[1] + 0.001 * grad**2
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(places, float(params[0][0]), params[1], params[2])


def _log_ratio(n: np.ndarray, pos: np.ndarray, share: float) -> np.ndarray:
    """The log-likelihood ratio that a group of n rows with pos positive ones gives against the share of all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(k > 0.5, k * np.log(k / (n * e)), 0.0) for k, e in ((pos, share), (n - pos, 1 - share))]
    return parts[0] + parts[1]


def telling_in_pairs(x: np.ndarray, y: np.ndarray, least: float = 25.0) -> np.ndarray:
    """Columns of a 0/1 matrix that in a pair tell the labels apart by ``least`` more than its two do alone; over a million pairs of chance don't."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    both, both_pos = (x.T @ x).astype(np.float64), (x.T @ (x * y[:, None])).astype(np.float64)
    n, pos, share = np.diag(both), np.diag(both_pos), float(y.mean())
    alone = _log_ratio(n, pos, share) + _log_ratio(len(y) - n, y.sum() - pos, share)
    cells = ((both, both_pos), (n[:, None] - both, pos[:, None] - both_pos), (n[None, :] - both, pos[None, :] - both_pos), (len(y) - n[:, None] - n[None, :] + both, y.sum() - pos[:, None] - pos[None, :] + both_pos))
    pair = sum(_log_ratio(a, b, share) for a, b in cells) - alone[:, None] - alone[None, :]
    np.fill_diagonal(pair, 0)
    return np.flatnonzero(pair.max(axis=1, initial=0) > least)


def _distinct_pairs(words: Words, keep: np.ndarray | None = None, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place), or with a table of kept places (text, kept term)."""
    at = term_places(words)
    doc = words.text_of(np.arange(at.shape[1]))
    if keep is None:
        pair = np.unique((np.broadcast_to(doc, at.shape) << PLACES | at).ravel())
        return pair >> PLACES, pair & ((1 << PLACES) - 1)
    kind, col = np.nonzero(keep[at])
    pair = np.unique(doc[col] * len(places) + np.searchsorted(places, at[kind, col]))
    return pair // len(places), pair % len(places)


def train(labelled: DataFrame, terms: int = 2048, frequent: int = 1024, factors: int = 8, epochs: int = 250, decay: float = 2e-5) -> Machine:
    """labelled: ``text, y`` with at most about sample_rows rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy()
            for a, b in slices(texts):
                doc, place = _distinct_pairs(Words(texts[a:b]))
                found, where = np.unique(place, return_inverse=True)
                pos = np.bincount(where, y[a:b][doc], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(pos), pa.array(np.bincount(where).astype(np.int64))], names=["place", "pos", "n"])

    total = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    if not n or not 0 < pos < n:
        share = pos / n if n else 0.0
        return Machine(np.zeros(0, dtype=np.int64), float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    counts = written(labelled.mapInArrow(count, "place long, pos long, n long").groupBy("place").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= 3))
    # The log-likelihood ratio of the 2 x 2 table of term and label.
    cell = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    p, t = F.col("pos").cast("double"), F.col("n").cast("double")
    ratio = sum((cell(k, e) for k, e in ((p, t * pos / n), (t - p, t * (n - pos) / n), (pos - p, (n - t) * pos / n), (n - pos - t + p, (n - t) * (n - pos) / n))), F.lit(0.0))
    telling = {r["place"] for r in counts.select("place", ratio.alias("g")).where(F.col("g") > 6).orderBy(F.desc("g"), "place").limit(terms).collect()}
    usual = {r["place"] for r in counts.orderBy(F.desc("n"), "place").limit(frequent).collect()}
    places = np.array(sorted(telling | usual), dtype=np.int64)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << PLACES, dtype=bool)
        keep[places] = True
        for batch in batches:
            texts, y = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                doc, term = _distinct_pairs(Words(texts[a:b]), keep, places)
                own = np.split(term.astype(np.int32), np.searchsorted(doc, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), y.slice(a, b - a)], names=["terms", "y"])

    rows = labelled.mapInArrow(features, "terms array<int>, y int").toArrow()
    owner = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows.column("terms")).to_numpy())
    term, y = rows.column("terms").combine_chunks().flatten().to_numpy(), rows.column("y").to_numpy().astype(np.float64)

    def matrix(kept: np.ndarray, dtype: type) -> np.ndarray:
        column = np.full(len(places), -1)
        column[kept] = np.arange(len(kept))
        x, own = np.zeros((len(y), len(kept)), dtype=dtype), column[term] >= 0
        x[owner[own], column[term[own]]] = 1
        return x

    kept = np.flatnonzero(np.isin(places, list(usual)))
    kept = np.union1d(kept[telling_in_pairs(matrix(kept, np.float32), y)], np.flatnonzero(np.isin(places, list(telling))))
    if not len(kept):
        return Machine(places[kept], float(np.log(pos / (n - pos))), np.zeros(0), np.zeros((0, factors)))
    return fit(matrix(kept, np.float64), y, places[kept], factors, epochs, decay)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample_rows: int = 8192) -> DataFrame:
    """``text, y``: the labelled documents, or about sample_rows of them drawn by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    known = known if learn_from is None else known.where(learn_from)
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about sample_rows rows of 12 bytes.
    return written(keyed_texts(docs).join(F.broadcast(drawn), "doc_id").select("text", "y"))


def score(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ()) -> DataFrame:
    """``rid, doc_id, score``, and ``carried`` if columns go along: one pass over the whole texts."""
    rows = keyed_texts(docs, carry)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        keep = np.zeros(1 << PLACES, dtype=bool)
        keep[m.places] = True
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                if len(m.places):
                    doc, term = _distinct_pairs(Words(texts[a:b]), keep, m.places)
                else:
                    doc = term = np.zeros(0, dtype=np.int64)
                p = 1 / (1 + np.exp(-np.clip(m.margins(doc, term, b - a), -30, 30)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), *part.columns[3:]], names=["rid", "doc_id", "score", *part.schema.names[3:]])

    return rows.mapInArrow(run, "rid long, doc_id long, score double" + carried_schema(rows))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample_rows: int = 8192, **options) -> DataFrame:
    """``rid, doc_id, score``, learned from the labels that learn_from (a condition on doc_id) admits."""
    return score(docs, train(labelled_sample(docs, labels, learn_from, sample_rows), **options))
