"""Pairs of fingerprints that lie near each other, by the generalised pigeonhole principle.

Bits that go together (by their correlation over all fingerprints) share a partition. For every number of partitions, dynamic
programming deals the partitions' thresholds, which sum to ``max_bits - partitions + 1`` (-1 leaves a partition out), at the least
estimated cost: signatures sent plus candidate pairs. Two fingerprints within max_bits agree within its threshold on at
least one partition. The estimates only steer the cost.

Fingerprints meet by partition value (with all values within the threshold from one side). In a bucket of at most ``bucket_rows`` all
pairs are candidates. In a crowded one each is paired with the bucket's hubs first: the fingerprint that meets the most others, and three at
random; what their verified links leave apart is compared pair by pair, a bucket's rows dealt over many tasks (``pairs_dealt``), or, where
fingerprints stand for sets, meets by the sets' prefixes (``pairs_by_sets``), whose rows don't grow with the square of the bucket; members
of a frequent prefix are compared in blocks of arrays (``pairs_in_blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_dealt, written

#: Rows of a bucket that one task compares with the others, pairs of a hub that one task verifies, and rows of each side of a block.
DEAL_ROWS, DEAL_PAIRS, BLOCK_ROWS = 512, 2048, 4096
#: (word of the fingerprint, bits, threshold) of a partition that is probed.
Part = tuple[int, list[int], int]


def bit_sums(fingerprints: DataFrame, n_words: int) -> np.ndarray:
    """For each of the words of a column ``f array<long>``: how many rows have bits i and j, for all i and j; summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_words, 64, 64))
        for batch in batches:
            words = batch.column(0).flatten().to_numpy().reshape(-1, n_words)
            for at in range(0, len(words), 10_000):
                for w in range(n_words):
                    b = np.unpackbits(words[at : at + 10_000, w].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                    total[w] += b.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "n"])

    sums = fingerprints.select("f").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_words * 4096)
    out[sums["cell"]] = sums["n"]
    return out.reshape(n_words, 64, 64)


def partitions_of_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits 0 (highest) to 63 in m groups of nearly equal size, each grown by the bit that correlates most with it."""
    p = np.diag(together) / n
    cov = np.abs(together / n - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p) + 1e-9, p * (1 - p) + 1e-9))
    left, out = list(range(64)), []
    for k in range(m):
        own = [left.pop(0)]
        while len(own) < (64 * (k + 1)) // m - (64 * k) // m:
            own.append(left.pop(int(np.argmax(cov[np.ix_(own, left)].sum(axis=0)))))
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << (63 - b) for b in bits)


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def ball(bits: list[int], radius: int) -> list[int]:
    """Signed masks that flip at most radius of the bits."""
    return [_signed(_mask(list(c))) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(sample: np.ndarray, together: np.ndarray, n: int, max_bits: int, row_cost: float = 40.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each partition that is probed, at the least estimated cost."""
    best: tuple[float, list] = (float("inf"), [])
    a, b = np.triu_indices(len(sample), 1)
    apart = sample.view(np.uint64)[a] ^ sample.view(np.uint64)[b]
    for m in range(1, max_bits + 2):
        groups = partitions_of_bits(together, n, m)
        options = []
        for bits in groups:
            distance = np.bitwise_count(apart & np.uint64(_mask(bits)))
            costs = {-1: 0.0}
            for t in range(max_bits + 1):
                size = sum(comb(len(bits), r) for r in range(t + 1))
                share = max(size / 2.0 ** len(bits), float((distance <= t).mean()) if len(distance) else 0.0)
                costs[t] = row_cost * n * size + share * n * n / 2
            options.append(costs)
        # deal[s]: the least cost of thresholds for the partitions so far that sum to s
        deal: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in options:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in deal.items():
                for t, extra in costs.items():
                    if (c + extra, ts + [t]) < nxt.get(s + t, (float("inf"), [])):
                        nxt[s + t] = (c + extra, ts + [t])
            deal = nxt
        cost, ts = deal[max_bits - m + 1]
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def plan(nodes: DataFrame, n_words: int, max_bits: int, sample_rows: int = 2000) -> list[Part]:
    """Partitions of the fingerprints ``f array<long>`` of n_words words, each of which is probed within max_bits bits."""
    n = nodes.count()
    if not n:
        return []
    share = min(1.0, sample_rows / n)
    sample = np.array([r["f"] for r in nodes.where(F.pmod(F.xxhash64("f"), F.lit(1 << 30)) < int(share * (1 << 30))).select("f").collect()], dtype=np.int64).reshape(-1, n_words)
    together = bit_sums(nodes, n_words)
    return [(w, bits, t) for w in range(n_words) for bits, t in allocate(np.ascontiguousarray(sample[:, w]), together[w], n, max_bits)]


def flipped(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: value.bitwiseXOR(x))


def signatures(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """``part, value, own, node``: a row for each partition's value of a node, and (not own) for each value within its threshold."""
    rows = []
    for k, (w, bits, t) in enumerate(parts):
        mask, word = F.lit(_signed(_mask(bits))).cast("long"), F.col("f")[w]
        entry = lambda own, k=k, mask=mask: lambda x: F.struct(F.lit(k).alias("part"), x.bitwiseAND(mask).alias("value"), F.lit(own).alias("own"))
        rows.append(F.array(entry(True)(word)))
        if t:
            rows.append(F.transform(flipped(word, ball(bits, t)[1:]), entry(False)))
    return nodes.select("node", F.explode(F.concat(*rows)).alias("s")).select("s.part", "s.value", "s.own", "node")


def _shares(rows: Column, per: int) -> Column:
    return F.ceil(rows / per).cast("int")


def _share_of(node: Column, shares: Column) -> Column:
    return F.pmod(F.xxhash64(node), shares.cast("long")).cast("int")


def _each_share(shares: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), shares - 1))


def _pair(a: str, b: str) -> list[Column]:
    """A pair in order of its nodes, with how many others each may meet."""
    x, y = F.least(a, b), F.greatest(a, b)
    return [x["node"].alias("a"), y["node"].alias("b"), x["reach"].alias("reach_a"), y["reach"].alias("reach_b")]


def meetings(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """``part, value, rows, own, x``: the members of each bucket of several; x: ``node, reach, f`` and the nodes' other columns."""
    rows = signatures(nodes, parts)
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("rows"), F.max("own").alias("any")).where((F.col("rows") > 1) & F.col("any")).drop("any")
    met = written(rows.join(written(sizes), ["part", "value"]))
    reach = met.groupBy("node").agg(F.sum("rows").alias("reach"))
    known = reach.join(nodes, "node").select("node", F.struct("node", "reach", *[c for c in nodes.columns if c != "node"]).alias("x"))
    return written(met.join(known, "node").select("part", "value", "rows", "own", "x"))


Near = Callable[[Column, Column], Column]
#: The same of the columns of two sets of nodes: an array of which of the first is near which of the second.
Close = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def pairs_inside(met: DataFrame, near: Near, bucket_rows: int) -> DataFrame:
    """``a, b, reach_a, reach_b``: the near pairs of buckets that aren't crowded."""
    few = met.where(F.col("rows") <= bucket_rows)
    l, r = few.where("own").alias("l"), few.alias("r")
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.value") == F.col("r.value"))
    once = (F.col("l.x.node") < F.col("r.x.node")) | (~F.col("r.own") & (F.col("l.x.node") != F.col("r.x.node")))
    return l.join(r, same & once & near(F.col("l.x"), F.col("r.x"))).select(*_pair("l.x", "r.x")).distinct()


def pairs_with_hubs(crowded: DataFrame, near: Near) -> DataFrame:
    """The near pairs of each crowded bucket's members with its hubs."""
    at_random = [F.max(F.struct(F.xxhash64("x.node", "part", F.lit(k)), "x"))["x"] for k in range(3)]
    hubs = crowded.groupBy("part", "value").agg(F.array(F.max(F.struct("x.reach", "x"))["x"], *at_random).alias("hubs"), F.first("rows").alias("rows"))
    hubs = hubs.select("part", "value", "hubs", _each_share(_shares(F.col("rows"), DEAL_PAIRS)).alias("share"))
    members = crowded.withColumn("share", _share_of(F.col("x.node"), _shares(F.col("rows"), DEAL_PAIRS)))
    close = F.filter("hubs", lambda hub: (hub["node"] != F.col("x.node")) & near(F.col("x"), hub))
    met = members.join(hubs, ["part", "value", "share"]).select("x", F.explode(close).alias("hub"))
    return met.select(*_pair("x", "hub")).distinct()


def rows_apart(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """``part, value, rows, share, x, root``: the members of crowded buckets that the links so far (``node, root``) don't connect."""
    rows = crowded.withColumn("node", F.col("x.node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows.select("part", "value", "rows", "x", "root"))
    open_ = rows.groupBy("part", "value").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.first("rows").alias("rows")).where(F.col("least") != F.col("most"))
    open_ = open_.select("part", "value", _each_share(_shares(F.col("rows"), DEAL_ROWS)).alias("share"))
    return written(rows.withColumn("share", _share_of(F.col("x.node"), _shares(F.col("rows"), DEAL_ROWS))).join(open_, ["part", "value", "share"]))


def pairs_dealt(rows: DataFrame, keys: list[str], near: Near) -> DataFrame:
    """The near pairs of different roots among the rows (``rows, share, x, root``) of equal keys; all rows of a key meet, over several tasks."""
    l, r = rows.alias("l"), rows.withColumn("to", _each_share(_shares(F.col("rows"), DEAL_ROWS))).alias("r")
    same = reduce(and_, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys)) & (F.col("l.share") == F.col("r.to"))
    apart = (F.col("l.x.node") < F.col("r.x.node")) & (F.col("l.root") != F.col("r.root"))
    return l.join(r, same & apart & near(F.col("l.x"), F.col("r.x"))).select(*_pair("l.x", "r.x")).distinct()


def _arrays(rows: pa.Table) -> dict[str, np.ndarray]:
    """Columns by name; lists of numbers as rows of unsigned words."""
    out = {}
    for name in rows.column_names:
        column = rows.column(name).combine_chunks()
        listed = pa.types.is_list(column.type)
        out[name] = column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1) if listed else column.to_numpy()
    return out


def pairs_in_blocks(rows: DataFrame, key: str, close: Close) -> DataFrame:
    """The close pairs of different roots among the rows (``rows, x, root``) of equal keys: a group is two shares of a key, compared as arrays."""
    shares = _shares(F.col("rows"), BLOCK_ROWS)
    dealt = rows.withColumn("share", _share_of(F.col("x.node"), shares)).withColumn("to", _each_share(shares))
    dealt = dealt.select(key, F.least("share", "to").alias("low"), F.greatest("share", "to").alias("high"), "share", "root", "x.*")

    def run(table: pa.Table) -> pa.Table:
        every = _arrays(table)
        low, high = every["low"][0], every["high"][0]
        l, r = ({name: c[every["share"] == share] for name, c in every.items()} for share in (low, high))
        ends = []
        for at in range(0, len(l["node"]), 256):
            part = {name: c[at : at + 256] for name, c in l.items()}
            hit = close(part, r) & (part["root"][:, None] != r["root"])
            if low == high:
                hit &= part["node"][:, None] < r["node"]
            i, j = np.nonzero(hit)
            turned = part["node"][i] > r["node"][j]
            for name in ("node", "reach"):
                x, y = part[name][i], r[name][j]
                ends.append((np.where(turned, y, x), np.where(turned, x, y)))
        columns = [np.concatenate([e[side] for e in ends[k::2]]) if ends else np.zeros(0, np.int64) for k in (0, 1) for side in (0, 1)]
        return pa.table(columns, names=["a", "b", "reach_a", "reach_b"])

    return dealt.groupBy(key, "low", "high").applyInArrow(run, "a long, b long, reach_a long, reach_b long").distinct()


def pairs_by_sets(members: DataFrame, sets: DataFrame, near: Near, close: Close, bucket_rows: int = 64) -> DataFrame:
    """The near pairs of different roots among the members (``node, root, x``), of those whose sets (``node, shingles``) have a similarity of 0.8 or more.

    close tells of arrays what near tells of columns: shingles of more than bucket_rows members are compared by it, in blocks.

    By prefixes: in one order of all shingles, two such sets share one of the first n / 5 + 1 of each. Shingles that only one root holds come
    first in that order and bring nobody together, then the less frequent ones; so a set with a fifth of its own meets none, whatever boilerplate it shares.
    """
    tokens = written(sets.join(members.select("node", "root"), "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token")))
    held = tokens.groupBy("token").agg(F.count("*").alias("weight"), F.min("root").alias("least"), F.max("root").alias("most"))
    between = written(held.where(F.col("least") != F.col("most")).select("token", "weight"))
    own = join_dealt(tokens, between, "token", tokens.count(), stored=True).groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("weight", "token"))).alias("order"))
    left = F.floor(F.col("n") / 5).cast("int") + 1 - (F.col("n") - F.size("order"))
    prefix = own.withColumn("left", left).where("left > 0").select("node", "root", F.explode(F.slice("order", 1, F.col("left"))).alias("first"))
    prefix = written(prefix.select("node", "root", "first.token"))
    sizes = written(prefix.groupBy("token").agg(F.count("*").alias("weight")).where("weight > 1"))
    rows = join_dealt(prefix, sizes, "token", prefix.count(), stored=True).join(members.select("node", "x"), "node")
    rows = written(rows.select("token", F.col("weight").alias("rows"), F.lit(0).alias("share"), "x", "root"))
    few = F.col("rows") <= bucket_rows
    return pairs_dealt(rows.where(few), ["token"], near).union(pairs_in_blocks(rows.where(~few), "token", close)).distinct()


def agree(parts: list[Part], x: Column, y: Column) -> Column:
    """Whether two nodes have a partition's value in common."""
    return reduce(or_, (x["f"][w].bitwiseXOR(y["f"][w]).bitwiseAND(F.lit(_signed(_mask(bits))).cast("long")) == 0 for w, bits, _ in parts))


def agreeing(parts: list[Part], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What ``agree`` tells, of all fingerprints x with all y."""
    same = np.zeros((len(x), len(y)), dtype=bool)
    for w, bits, _ in parts:
        mask = np.uint64(_mask(bits))
        same |= (x[:, None, w] & mask) == (y[None, :, w] & mask)
    return same


def connecting_links(
    nodes: DataFrame,
    parts: list[Part],
    near: Near,
    bucket_rows: int,
    verified: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    apart: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``a, b``: verified links that connect all nodes (``node, f array<long>``) which verified pairs of the candidates connect.

    apart: gives the candidates among the rows of ``rows_apart``; by default all near pairs.
    """
    met = meetings(nodes, parts)
    crowded = met.where(F.col("rows") > bucket_rows)
    first = written(verified(written(pairs_inside(met, near, bucket_rows).union(pairs_with_hubs(crowded, near)).distinct())).select("a", "b"))
    if crowded.isEmpty():
        return first
    rows = rows_apart(crowded, components(first))
    if rows.isEmpty():
        return first
    pairs = written(apart(rows) if apart else pairs_dealt(rows, ["part", "value"], near))
    return first.union(verified(pairs).select("a", "b"))


def with_share_of(pairs: DataFrame, side: str, table: DataFrame, value: str) -> DataFrame:
    """pairs with the ``value`` that the table (``node, reach, value``) has for one side; the pairs of a node that meets many are dealt over several tasks."""
    other = "b" if side == "a" else "a"
    dealt = pairs.withColumn("share", _share_of(F.col(other), _shares(F.col(f"reach_{side}"), DEAL_PAIRS)))
    each = table.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}"), _each_share(_shares(F.col("reach"), DEAL_PAIRS)).alias("share"))
    return dealt.join(each, [side, "share"]).drop("share")
