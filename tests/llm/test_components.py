"""Components end settled, or with an error."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import pigeonhole
from strataflow.llm.components import PART_EDGES, _with_least, components, least_connected
from strataflow.llm.pigeonhole import pairs_by_sets


def test_unsettled_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(path, max_rounds=1, part_edges=4)
    for part_edges in (4, 13, PART_EDGES):
        assert [tuple(r) for r in components(path, part_edges=part_edges).orderBy("node").collect()] == [(i, 0) for i in range(1, 41)]


@pytest.mark.parametrize("part_edges", [7, 50, PART_EDGES])
def test_same_components_in_parts(spark, part_edges):
    """Random trees and stars, ids of either sign, repeated edges and edges to oneself: the brute-force roots at any size of the parts."""
    rng = random.Random(part_edges)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(200)]
    edges = [(ids[i], ids[rng.choice((i, i - 1, i // 20 * 20))]) for i in range(200) if i % 20] * 2
    root = {x: x for x in ids}
    for _ in ids:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"), part_edges=part_edges).collect()
    assert sorted(map(tuple, got)) == sorted((x, root[x]) for x in linked if root[x] != x)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), part_edges=part_edges).isEmpty()


def test_least_connected():
    """A high centre over low leaves, a path, two apart."""
    nodes, least = least_connected(np.array([9, 9, 9, 20, 21, 22, 40]), np.array([3, 1, 2, 21, 22, 23, 41]))
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 23: 20, 40: 40, 41: 40}


def test_stars_are_dealt(spark):
    """A centre of 30,000 edges is joined by broadcasting it: its edges stay where they are."""
    star = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    pairs = spark.range(40_000, 70_000).select((2 * F.col("id")).alias("u"), (2 * F.col("id") + 1).alias("v"))
    edges = star.union(pairs)
    joined = _with_least(edges, edges, 60_000)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    assert joined.where("u = 0").agg(F.count("*"), F.max("m")).first() == (30_000, 1) and joined.count() == 60_000
    roots = components(edges.toDF("a", "b"), part_edges=20_000)
    assert roots.where("root = 0").count() == 30_000 and roots.where("root >= 80000").count() == 30_000


@pytest.mark.parametrize("bucket_rows, block_rows", [(64, 4096), (1, 4096), (1, 3)])
def test_pairs_by_sets(spark, monkeypatch, bucket_rows, block_rows):
    """Every pair of a similarity of 0.8 meets; sets that share most, but have a fifth of their own, bring nobody together."""
    monkeypatch.setattr(pigeonhole, "BLOCK_ROWS", block_rows)
    rng = random.Random(2)
    common = range(1000, 1100)
    sets = {i: {*common, *range(10_000 + 50 * i, 10_030 + 50 * i)} for i in range(400)}
    for i in range(400, 460):
        family = (i - 400) // 6
        sets[i] = {t if rng.random() > 0.06 else 10**6 + rng.randrange(10**6) for t in range(200_000 + 100 * family, 200_080 + 100 * family)}
    root = {i: i if i % 5 else i - i % 10 for i in sets}
    members = spark.createDataFrame([(i, root[i], (i, 7)) for i in sets], "node long, root long, x struct<node: long, reach: long>")
    tokens = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<long>")
    close = lambda x, y: np.ones((len(x["node"]), len(y["node"])), dtype=bool)
    found = pairs_by_sets(members, tokens, lambda x, y: F.lit(True), close, bucket_rows).collect()
    got = {(r["a"], r["b"]) for r in found}
    assert len(got) == len(found) and all(a < b for a, b in got)
    want = {(a, b) for a, b in combinations(sets, 2) if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= got and not any(a < 400 and b < 400 for a, b in got)
