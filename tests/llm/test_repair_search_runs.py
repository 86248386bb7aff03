"""Conversation repair, exact search and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from itertools import product

import numpy as np
import pytest

from strataflow.llm import chat_repair, cover_search, periodic_runs

# --- conversation repair ---

CONVERSATIONS = "conv_id long, turn long, role string, text string, n long, marks string, conv string"


def conversations():
    rng, rows = random.Random(3), []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", " \t", "", None, f"word {turn}.", "é ", "done.\n", "so. \x0b"])
            rows += [(conv, rng.choice([turn, turn, turn + 3, 1, None]), role, text, 1, "m", "c")] * rng.choice([1, 1, 1, 2])
    # One conversation with most rows, many of them alike.
    rows += [(100, i // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", f"t{i}.", f"t{i}"]), 1, "m", "c") for i in range(300)]
    return rows + [(101, None, "user", "x" * 5000, 1, "", ""), (102, 7, "assistant", None, 1, "", "")]


def repaired(rows):
    """A plain recursion over the whole conversation with the least audit of each state."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in turns:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not said else "d" if (role, text) in seen else "-" if said[-1] in ".!?" else "t")
            seen.add((role, text))
        legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        added = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        def with_added(best):
            for _ in range(4):
                for q, (cost, audit, told) in list(best.items()):
                    to, new = added[q][0], (cost + 3, audit + "I", [*told, f"{added[q]}:"])
                    best[to] = min(best.get(to, (math.inf,)), new)
            return best

        best = {"": (0, "", [])}
        for (_, role, text), fault in zip(turns, faults, strict=True):
            new = {}
            for q, (cost, audit, told) in with_added(best).items():
                ways = [(q, 4, "D", told)]
                if fault not in "bd":
                    more = 3 * (fault == "t")
                    ways += [(legal[q, role[:1]], more, "K", [*told, f"{role}:{text}"])] if (q, role[:1]) in legal else []
                    ways.append((added[q][0], 3 + more, "R", [*told, f"{added[q]}:{text}"]))
                for to, c, letter, t in ways:
                    new[to] = min(new.get(to, (math.inf,)), (cost + c, audit + letter, t))
            best = new
        cost, audit, told = min(v for q, v in with_added(best).items() if q in ("", "a"))
        known = sorted({t[0] for t in turns if t[0] is not None})
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows,chars", [(1024, 1 << 15), (3, 1 << 15), (1, 1), (50, 40)])
def test_repair(spark, rows, chars):
    table = conversations()
    df = spark.createDataFrame(table, CONVERSATIONS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in chat_repair.repair(chat_repair.damaged(df), rows, chars).collect()}
    want = repaired(table)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repair_of_nothing(spark):
    assert chat_repair.repair(chat_repair.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_all_edits_of_short_conversations():
    """The vectors against all ways to edit."""
    for marks in map("".join, product(["s-", "u-", "a-", "ub", "at", "?-"], repeat=3)):
        vector, costs = chat_repair.backward(marks, chat_repair.END)
        least = {}

        def walk(i, q, cost, audit, marks=marks, least=least):
            if cost > 21 or audit.endswith("III"):
                return
            if i == len(marks) and q in (0, 3):
                least[cost] = min(audit, least.get(cost, "Z"))
            walk(i, chat_repair.NEXT[q], cost + 3, audit + "I")
            if i < len(marks):
                for letter, c, to in chat_repair.edits(q, marks[i], marks[i + 1]):
                    walk(i + 2, to, cost + c, audit + letter)

        walk(0, 0, 0, "")
        letters, q = chat_repair.forward(marks, chat_repair.END, costs, 0)
        assert (vector[0] + sum(costs[4::5]), letters + chat_repair.closing(q)) == min(least.items())


def test_a_run_from_another_vector_stops_where_both_agree():
    rng = random.Random(1)
    for _ in range(200):
        marks = "".join(rng.choice("sua?") + rng.choice("--bdt") for _ in range(rng.randint(0, 12)))
        old = chat_repair.backward(marks, chat_repair.END)[1]
        right = rng.choice([(0, 3, 0, 0), (3, 3, 0, 3), (0, 0, 0, 0)])
        assert chat_repair.backward(marks, right, old or None) == chat_repair.backward(marks, right)


# --- exact search ---

VECTORS = "vec_id long, embedding array<float>, tree string, rank int"


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + 0.05 * rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 1.0, 0.0, 2.0]) for i in range(150)]  # copies
    rows += [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (100, []), (150, None), (2000, [1.0, None]), (2050, [float("nan")] * 6), (2100, [float("inf")] * 6), (None, [1.0] * 6), (-50, [0.0] * 6)]
    return [(i, v, "t", 1) for i, v in rows]


def best_products(rows, k):
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(own):
        if q % 50 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=False)))), c) for j, (c, w) in enumerate(own) if j != at)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    from pyspark.sql import functions as F

    whole = df.select("vec_id", cover_search.whole(F.col("embedding")).alias("v"))
    return sorted(map(tuple, cover_search.top_products(whole, F.col("vec_id") % 50 == 0, k).collect()))


@pytest.mark.parametrize("settings", [{}, {"SLICE": 40, "BUCKET": 4, "SAMPLE": 20, "PIVOTS": 5, "BLOCK_BYTES": 2000}, {"SLICE": 7, "BUCKET": 1, "SAMPLE": 1000}])
def test_search(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(cover_search, name, value)
    rows = vectors()
    assert searched(spark, rows) == best_products(rows, 5)


def test_search_of_few_and_large(spark):
    assert searched(spark, []) == []
    few = [(0, [1.0], "t", 1), (50, [2.0], "t", 1)]
    assert searched(spark, few) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    large = [(50 * i, [1e30 * (-1) ** i, 3.0e8 + 1000 * i], "t", 1) for i in range(4)]
    assert searched(spark, large) == best_products(large, 5)


def test_node_pairs_are_pruned():
    """In clusters that are far apart few products are taken, and all that count."""
    rng = np.random.default_rng(1)
    centres = 2000 * rng.normal(size=(20, 8))
    points = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)))
    tree = cover_search.Packed({k: v for k, v in cover_search._packed(points, [[i] for i in range(1000)], np.full(1000, cover_search.NONE)).items()})
    best = cover_search.Best(tree, 3)
    taken = cover_search.dual(tree, tree, best)
    assert taken < 1000 * 1000 / 2
    scores = tree.points @ tree.points.T
    want = np.sort(scores, axis=1)[:, ::-1][:, :3]
    assert np.array_equal(np.array(best.scores).reshape(1000, 3), want)


def test_covering_and_separation():
    points = np.floor(50 * np.random.default_rng(2).normal(size=(400, 3)))
    tree = cover_search.Packed(cover_search._packed(np.unique(points, axis=0), [[0]] * len(np.unique(points, axis=0)), np.zeros(len(np.unique(points, axis=0)), dtype=np.int64)))
    for centre, radius, first, end, children in tree.nodes:
        apart = np.sqrt(((tree.points[first:end] - tree.points[centre]) ** 2).sum(axis=1))
        assert apart.max() <= radius + 1e-6
        assert [f for c in children for f in range(*tree.nodes[c][2:4])] == (list(range(first, end)) if children else [])
        own = [c for c in children if tree.nodes[c][4]]
        for i, a in enumerate(own):
            for b in own[:i]:
                assert np.sqrt(((tree.points[tree.nodes[a][0]] - tree.points[tree.nodes[b][0]]) ** 2).sum()) > radius / 2 - 1e-6


# --- periodic runs ---


def all_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_texts():
    rng, out = random.Random(9), [None, "", " \n", "a", "a a a a a a", "a b a b a b a b", "x " * 3000, "ab\x85 ab　 " * 40]
    for alphabet in (1, 2, 3, 50):
        for n in (5, 20, 60, 300):
            out.append(" ".join(rng.choice("abcdefghij") * (1 + rng.randrange(alphabet)) for _ in range(n)))
    for period in (1, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100):
        unit = [rng.choice("abc") for _ in range(period)]
        for length in (4 * period - 1, 4 * period, 4 * period + 3, 6 * period + 1):
            words = (unit * 7)[:length]
            out.append("\t".join([*(rng.choice("abcd") for _ in range(rng.randrange(9))), *words, *(rng.choice("abcd") for _ in range(rng.randrange(9)))]))
            out.append(" ".join([*words, "|", *words[::-1], "|", *words]))
    return out


@pytest.mark.parametrize("together", [1 << 18, 50])
def test_runs(spark, monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "WORDS", together)
    texts = plain_texts()
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int").repartition(2)
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        want = all_runs(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, t
        gone = {j for s, n, p in want for j in range(s + p, s + n)}
        assert got[i]["collapsed"].encode() == b" ".join(w for j, w in enumerate(words) if j not in gone)


def test_run_digests(spark, texts):
    """With planted repeats, null ids and repeated rows."""
    rows = [*enumerate(texts), (None, "a b " * 9), (3, texts[3]), (None, None)]
    got = sorted(map(repr, map(tuple, periodic_runs.digests(periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), periodic_runs.repeated)).collect())))
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        own = all_runs(words) if n < 2000 else [tuple(map(int, r)) for r in zip(*periodic_runs.found_runs([words])[0], strict=True)]
        top = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {j for s, m, p in own for j in range(s + p, s + m)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in own)
        want.append((i, len(own), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(map(repr, want))
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_of_words_and_repeats():
    rng = random.Random(4)
    unit = [str(rng.randrange(500)).encode() for _ in range(30_000)]
    words = [b"x"] * 17 + unit * 4 + unit[:7] + [b"y"] * 100_000
    assert list(zip(*(c.tolist() for c in periodic_runs.found_runs([words])[0]), strict=True)) == [(0, 17, 1), (17, 120_007, 30_000), (120_024, 100_000, 1)]
