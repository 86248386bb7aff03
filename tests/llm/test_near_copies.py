"""The pipeline's near-duplicate stage against all pairs by exact similarity."""

import random
from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from strataflow.llm import simhash_dedup
from strataflow.llm.pigeonhole import plan


def shingle_set(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute_groups(texts, may_meet=lambda i, j: True):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and may_meet(i, j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) if sets[i] else None for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies(texts):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))

    def changed(own, n):
        own = list(own)
        for i in rng.sample(range(len(own)), n):
            own[i] = word()
        return own

    base = [[word() for _ in range(rng.choice([40, 90, 200]))] for _ in range(40)]
    out = [b if not k else changed(b, k) for b in base for k in (0, 1, 2, 3, len(b) // 45, len(b) // 40)]
    hot = [word() for _ in range(120)]
    out += [changed(hot, rng.randint(0, 4)) for _ in range(90)]
    out += [hot[:20] + [word() for _ in range(rng.randint(3, 60))] for _ in range(40)]
    return [*texts, *(" ".join(o) for o in out)]


def same_groups(got, want):
    return got.keys() == want.keys() and len(set(got.values())) == len(set(want.values())) == len(set(zip(got.values(), (want[i] for i in got), strict=True)))


@pytest.mark.parametrize("bucket_rows", [2, 1000])
def test_groups(spark, copies, bucket_rows):
    """Exactly the groups of the verified candidates: texts that share a partition's value and are within FAR_BITS."""
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(5)
    nodes = simhash_dedup.profiles(docs).dropDuplicates(["node"])
    parts = plan(nodes, simhash_dedup.WORDS_64, 1)
    assert len(parts) == 20 and all(t == 0 and len(bits) == 32 for _, bits, t in parts)
    fps = {r["doc_id"]: [x & (1 << 64) - 1 for x in r["f"]] for r in simhash_dedup.profiles(docs).collect()}
    masks = [(w, sum(1 << 63 - b for b in bits)) for w, bits, _ in parts]

    def may_meet(i, j):
        apart = [x ^ y for x, y in zip(fps[i], fps[j], strict=True)] if i in fps and j in fps else None
        return bool(apart) and any(not apart[w] & m for w, m in masks) and sum(x.bit_count() for x in apart) <= simhash_dedup.FAR_BITS

    got = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(docs, bucket_rows=bucket_rows).collect()}
    assert same_groups(got, {i: g for i, g in enumerate(brute_groups(copies, may_meet)) if g is not None})


def test_recall_and_precision(spark, copies):
    """No pair is linked wrongly, and nearly all pairs of a similarity of 0.8 or more are."""
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(docs).collect()}
    sets, every = [shingle_set(t) for t in copies], brute_groups(copies)
    assert len(set(got.values())) == len(set(zip(got.values(), (every[i] for i in got), strict=True)))
    pairs = [(i, j) for i, j in combinations(got, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > 1000 and sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)


def test_stage_keeps_one_of_each_group(spark, copies):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(docs).collect()}
    first = {}
    for i in sorted(groups):
        first.setdefault(groups[i], i)
    want = {i for i in range(len(copies)) if i not in groups or first[groups[i]] == i}
    assert {r["doc_id"] for r in pipeline.copies_out(spark, docs, "").collect()} == want


def test_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert simhash_dedup.near_copies(docs).count() == simhash_dedup.near_copies(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    """A text of a million words and its near copy, beside short ones."""
    rng = random.Random(4)
    own = [f"w{rng.randrange(50_000)}" for _ in range(1_000_000)]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(own[5:])), (3, "short text"), (4, "short  TEXT")], "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4] != got[1]
