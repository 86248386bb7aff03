"""Exact search for the greatest inner products by cover trees of data and queries.

Vectors are whole numbers. A bounded sample gives pivots; rows are sorted by their nearest pivot (spread over range partitions, as one
pivot may have any share of them) and cut into slices of SLICE, each with a cover tree: a node's children are centres further apart
than half its radius, whose balls of that radius cover the node, and many small children share buckets. Queries, sorted likewise,
have trees of their own. A node's ball has the covering radius of what is below it, so for a pair of nodes with centres c, d and radii r, s

    <c, d> + r |d| + s |c| + r s

bounds every product between them. A pair goes if that is below the worst k-th score among the node's queries; others are split at the
larger ball, best bound first, down to products of whole buckets. Each query starts from its k-th best score against the
sample, which its true one reaches at least, so that a task hands on only what may count.

Query trees meet all data trees in blocks of bounded size, which are broadcast: that is the stated query set, and no pairs are shuffled.
Equal vectors of a slice are one point with its k + 1 smallest ids: of equal scores smaller ids come first, and a query leaves out one row, its own.

Null vectors, and those with null or infinite components or NaN, take no part. Shorter vectors count as if they ended in zeros. Null
ids take no part; a repeated id stands for each of its rows. Scores are exact, and beyond a long its greatest or least value. Further columns are left out,
whatever their names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Points of a slice, points of a bucket, rows of the sample and pivots.
SLICE, BUCKET, SAMPLE, PIVOTS = 1024, 128, 8192, 256
#: Query trees of one pass over the data take at most so many bytes.
BLOCK_BYTES = 32 << 20
NONE = -(1 << 63)


def whole(vector: Column, scale: float = 256.0) -> Column:
    """A vector's components as whole numbers; null if one is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return F.when(good, F.transform(vector, lambda x: floor(F.lit(scale) * x.cast("double"))))


class Tree:
    """points: in the tree's order; nodes: (centre's place, radius, first place, end, children), the root last."""

    def __init__(self, points: np.ndarray):
        gram = points @ points.T
        norms = np.diag(gram)
        self.apart = np.sqrt(np.maximum(0.0, norms[:, None] + norms[None, :] - 2 * gram))
        self.nodes: list[tuple[int, float, int, int, list[int]]] = []
        self.order: list[int] = []
        if len(points):
            self._node(np.arange(len(points)), 0)
        del self.apart

    def _add(self, centre: int, radius: float, children: list[int], first: int) -> int:
        self.nodes.append((centre, radius, first, len(self.order), children))
        return len(self.nodes) - 1

    def _node(self, own: np.ndarray, centre: int) -> int:
        """A node of the points, of which centre is one."""
        radius, first = float(self.apart[centre, own].max()), len(self.order)
        if len(own) <= BUCKET or radius == 0:
            self.order += own.tolist()
            return self._add(centre, radius, [], first)
        parts, left, at = [], own, centre
        while len(left):
            near = self.apart[at, left] <= radius / 2
            parts.append((at, left[near]))
            left = left[~near]
            at = int(left[0]) if len(left) else at
        children, small = [], []
        for at, part in parts:
            if 4 * len(part) > BUCKET:
                children.append(self._node(part, at))
            else:
                small.append(part)
        rest = np.concatenate(small) if small else np.zeros(0, dtype=np.int64)
        for i in range(0, len(rest), BUCKET):
            part, begin = rest[i : i + BUCKET], len(self.order)
            self.order += part.tolist()
            children.append(self._add(centre, float(self.apart[centre, part].max()), [], begin))
        return self._add(centre, radius, children, first)


def _packed(points: np.ndarray, ids: list[list[int]], floors: np.ndarray) -> dict:
    """A tree as a row."""
    tree = Tree(points)
    place = np.argsort(np.array(tree.order, dtype=np.int64))
    order, squares = tree.order, np.array([products(p[None], p[None], float(np.abs(p).max()) ** 2)[0, 0] for p in points])
    return {
        "dim": points.shape[1], "points": points[order].astype(np.int16 if np.abs(points).max(initial=0.0) < 1 << 15 else np.float64).tobytes(), "ids": [ids[i] for i in order], "floors": floors[order].tolist(), "squares": squares[order].tolist(),
        "nodes": [{"centre": int(place[c]), "radius": r, "first": f, "end": e, "children": ch} for c, r, f, e, ch in tree.nodes],
    }


_NODE = pa.struct([("centre", pa.int32()), ("radius", pa.float64()), ("first", pa.int32()), ("end", pa.int32()), ("children", pa.list_(pa.int32()))])
_TREE = pa.schema([("dim", pa.int32()), ("points", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("floors", pa.list_(pa.int64())), ("squares", pa.list_(pa.int64())), ("nodes", pa.list_(_NODE))])
_TREE_DDL = "dim int, points binary, ids array<array<bigint>>, floors array<bigint>, squares array<bigint>, nodes array<struct<centre: int, radius: double, first: int, end: int, children: array<int>>>"


class Packed:
    """A tree as read back."""

    def __init__(self, row: dict):
        small = len(row["points"]) < 8 * row["dim"] * len(row["ids"])
        self.points = np.frombuffer(row["points"], dtype=np.int16 if small else np.float64).astype(np.float64).reshape(-1, row["dim"])
        self.ids, self.nodes = row["ids"], [tuple(n[c] for c in ("centre", "radius", "first", "end", "children")) for n in row["nodes"]]
        self.floors = np.array(row["floors"], dtype=np.int64)
        self.norms = np.sqrt((self.points**2).sum(axis=1))
        self.largest = float(np.abs(self.points).max(initial=0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column as rows of dim numbers."""
    out, sizes = np.zeros((len(column), dim)), column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products as longs; largest: of the absolute components' products."""
    if largest * max(1, a.shape[1]) < 1 << 52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a.tolist()], dtype=object) @ np.array([[int(x) for x in r] for r in b.tolist()], dtype=object).T
    return np.clip(exact, NONE, -NONE - 1).astype(np.int64)


class Best:
    """The best rows of each query of a tree, k + 1 at most."""

    def __init__(self, queries: Packed, k: int):
        self.k, self.least = k, queries.floors.copy()
        self.q, self.ids, self.scores = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((at[1], ~at[2], at[0]))
        q, ids, scores = (c[order] for c in at)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        own = place < self.k
        self.q, self.ids, self.scores = q[own], ids[own], scores[own]
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])


def dual(queries: Packed, data: Packed, best: Best) -> int:
    """All pairs of two trees that may count; the number of products that were taken."""
    largest, taken = queries.largest * data.largest, 0
    slack = 1e-6 * (1 + queries.norms.max() * data.norms.max())

    def bounds(a: Packed, b: Packed, nodes: list[int], other: int) -> np.ndarray:
        """Of some nodes of one tree and one of the other."""
        c, r = [a.nodes[i][0] for i in nodes], np.array([a.nodes[i][1] for i in nodes])
        d, s, *_ = b.nodes[other]
        return a.points[c] @ b.points[d] + r * b.norms[d] + s * a.norms[c] + r * s + slack

    stack = [(np.inf, len(queries.nodes) - 1, len(data.nodes) - 1)]
    while stack:
        bound, i, j = stack.pop()
        (_, r, first, end, parts), (_, s, low, high, others) = queries.nodes[i], data.nodes[j]
        if bound < best.least[first:end].min():
            continue
        if parts and (r >= s or not others):
            pairs = [(b, n, j) for b, n in zip(bounds(queries, data, parts, j).tolist(), parts, strict=True)]
        elif others:
            pairs = [(b, i, n) for b, n in zip(bounds(data, queries, others, i).tolist(), others, strict=True)]
        else:
            taken += (end - first) * (high - low)
            scores = products(queries.points[first:end], data.points[low:high], largest)
            q, at = np.nonzero(scores >= best.least[first:end, None])
            if len(q):
                n = np.array([len(data.ids[low + x]) for x in at.tolist()])
                best.add(np.repeat(q + first, n), np.concatenate([data.ids[low + x] for x in at.tolist()]), np.repeat(scores[q, at], n))
            continue
        stack += sorted(pairs)  # the best is taken first
    return taken


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    """At most about SAMPLE vectors, drawn by a hash of the id; at least one, if there are any."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(2 * SAMPLE)
    table = drawn.select("v").toArrow()
    return _matrix(table.column(0).combine_chunks(), dim) if table.num_rows else np.zeros((0, dim))


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Vectors of the sample, each the furthest from those before it: the top of a cover tree."""
    if not len(sample):
        return sample
    chosen, apart = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def trees(rows: DataFrame, dim: int, k: int, sample: np.ndarray, pivots: np.ndarray, queries: bool) -> DataFrame:
    """Rows ``vec_id, v`` as cover trees, a row for each; as queries all ids of equal vectors stay, and floors are their k best scores against the sample."""
    held = rows.sparkSession.sparkContext.broadcast((sample, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value[1]
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            near = (_matrix(batch.column(1), dim) @ centres.T - half).argmax(axis=1) if len(centres) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "v", "pivot"])

    def packed(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        points, inverse = np.unique(vectors, axis=0, return_inverse=True) if len(vectors) else (vectors, np.zeros(0, dtype=np.int64))
        inverse = inverse.ravel()
        order = np.lexsort((ids, inverse))
        groups = np.split(ids[order], np.flatnonzero(np.diff(inverse[order])) + 1)
        own = [g.tolist() if queries else g[:k].tolist() for g in groups]
        floors = np.full(len(points), NONE, dtype=np.int64)
        known = held.value[0]
        if queries and len(known) >= k:
            scores = products(points, known, float(np.abs(points).max(initial=0.0)) * float(np.abs(known).max(initial=0.0)))
            floors = np.partition(scores, len(known) - k, axis=1)[:, len(known) - k]
        return pa.RecordBatch.from_pylist([_packed(points, own, floors)], schema=_TREE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, dtype=np.int64), np.zeros((0, dim))
        for batch in batches:
            ids, vectors = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([vectors, _matrix(batch.column(1), dim)])
            while len(ids) >= SLICE:
                yield packed(ids[:SLICE], vectors[:SLICE])
                ids, vectors = ids[SLICE:], vectors[SLICE:]
        if len(ids):
            yield packed(ids, vectors)

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, pivot int")
    near = placed.repartitionByRange("pivot", "vec_id").sortWithinPartitions("pivot", "v", "vec_id")
    return written(near.select("vec_id", "v").mapInArrow(build, _TREE_DDL).withColumn("tree", F.monotonically_increasing_id()))


_FOUND = "tree long, point int, vec_id long, score long"


def _searched(data: DataFrame, block: list[dict], k: int) -> DataFrame:
    held = data.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(row["tree"], Packed(row)) for row in held.value]
        best = [Best(q, k) for _, q in own]
        for batch in batches:
            for at in range(batch.num_rows):
                tree = Packed(batch.slice(at, 1).to_pylist()[0])
                for (_, q), b in zip(own, best, strict=True):
                    dual(q, tree, b)
        for (name, _), b in zip(own, best, strict=True):
            columns = [pa.array(np.full(len(b.q), name)), pa.array(b.q.astype(np.int32)), pa.array(b.ids), pa.array(b.scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "point", "vec_id", "score"])

    return data.select("dim", "points", "ids", "floors", "nodes").mapInArrow(run, _FOUND)


def top_products(vectors: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the greatest inner product for each asked row but itself, ties to the smaller id.

    vectors: ``vec_id, v`` with whole numbers in v, null where a row takes no part; asked: which rows are queries.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = _sample(rows, dim)
    pivots = _pivots(sample)
    data = trees(rows, dim, k + 1, sample, pivots, queries=False)
    queries = trees(rows.where(asked), dim, k + 1, sample, pivots, queries=True)
    n, size = queries.agg(F.count("*"), F.sum(F.length("points"))).first()
    blocks, found = max(1, -(-4 * (size or 0) // BLOCK_BYTES)), None
    for i in range(blocks if n else 0):
        block = [r.asDict(recursive=True) for r in queries.where(F.pmod(F.xxhash64("tree"), F.lit(blocks)) == i).collect()]  # bounded by BLOCK_BYTES
        part = _searched(data, block, k + 1)
        found = part if found is None else found.unionByName(part)
    found = found if found is not None else rows.sparkSession.createDataFrame([], _FOUND)
    place = F.row_number().over(W.partitionBy("tree", "point").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("place", place).where(F.col("place") <= k + 1)
    best = ranked.groupBy("tree", "point").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    points = queries.select("tree", F.posexplode(F.arrays_zip("ids", "squares")).alias("point", "x"))
    own = points.join(best, ["tree", "point"]).select(F.explode("x.ids").alias("query_id"), F.col("x.squares").alias("square"), "best")
    # The query's own row is one of its id with the product with itself; a row like it counts.
    itself = F.filter("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("square")))
    others = F.slice(F.filter("best", lambda x: ~F.coalesce(x["place"] == F.get(itself, F.lit(0))["place"], F.lit(False))), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
