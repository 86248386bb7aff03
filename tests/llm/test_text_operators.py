"""Operators over documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strataflow.llm import bpe_codec, decontaminate, hmm_lm, line_dedup, pigeonhole, simhash_dedup, substring_dedup, token_counts, toxicity
from strataflow.llm.decontaminate import Words
from strataflow.llm.shared import BLANK_SEPARATED

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_bpe_round_trip(docs, texts):
    encoding = bpe_codec.load_encoding(RANKS, public_tokenizers.PATTERN)
    for chunk in (50_000, 20):
        got = by_id(bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, rows_per_batch=7), "ids", "decoded")
        for i, t in enumerate(texts):
            assert got[i][0] == encoding.encode_ordinary(t or ""), (chunk, i)
            assert bytes(got[i][1]) == (t or "").encode()


def test_bpe_long_white_space(spark):
    """Runs that the library takes have its ids; longer ones those of the pattern's matches, taken one by one."""
    encoding = bpe_codec.load_encoding(RANKS, public_tokenizers.PATTERN)
    middle = ["a" + " " * 60_000 + "b c", "word\n" * 9 + "\n" * 30_000 + " x" + " \t\u2003" * 9_000, " " * 20_001, "x" + "\u00a0" * 15_000 + "y", "z " + " \n" * 40_000 + "end" + " " * 12_000 + "\x1c" * 20 + "q"]
    for text in middle:
        for chunk in (100, 50_000):
            assert bpe_codec.ids_of(encoding, text, chunk) == encoding.encode_ordinary(text)
    n = 2_000_000
    long = {"spaces": "a" + " " * n + "b", "lines": "a" + "\n" * n + "b", "mixed": "a" + " \n\t" * (n // 3) + " b", "end": "a " + " " * n, "blank": " " * n}
    docs = spark.createDataFrame(list(enumerate(long.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(long.values()):
        assert bytes(got[i]["decoded"]) == text.encode()
    pieces = [long["spaces"][1:n], " b"], [long["lines"][1:n], "\n", "b"], [("a" + " \n\t" * (n // 3))[1:], " b"], [long["end"][1:]], [long["blank"]]
    for i, own in enumerate(pieces):
        want = [t for x in (["a"] if i < 4 else []) + own for t in encoding._encode_single_piece(x)]
        assert got[i]["ids"] == want


@pytest.mark.parametrize("head_rows", [1 << 18, 40, 0])
def test_token_counts(docs, texts, head_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    got = by_id(token_counts.token_counts(docs, JSON, limit=100, head_rows=head_rows), "n_bytes", "n_tokens", "over_limit")
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 100), i


@pytest.mark.parametrize("head_rows", [1 << 18, 0])
def test_token_counts_of_long_and_hot_pretokens(spark, head_rows):
    """A separator in every text isn't joined; a text of one very long pre-token is."""
    from tokenizers import Tokenizer

    tokenizer, line = Tokenizer.from_file(JSON), "-" * 80
    own = [*(f"{line}\nw{i} {line}\n" for i in range(200)), "=" * 100_000, "a b " * 50_000]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = by_id(token_counts.token_counts(df, JSON, head_rows=head_rows), "n_tokens")
    assert got == {i: (len(tokenizer.encode(t, add_special_tokens=False).ids),) for i, t in enumerate(own)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_token_counts_refuse_other_tokenizers(tmp_path):
    import json

    with open(JSON, encoding="utf-8") as f:
        parts = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(parts | change), encoding="utf-8")
        with pytest.raises(ValueError):
            token_counts.pretokenizer(str(tmp_path / "t.json"))


def brute_contamination(texts, items, window=10):
    words = [WORD.findall(lower(t)) for t in texts]
    wanted = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[k : k + window])].add("null" if item is None else str(item))
    out = {}
    for i, w in enumerate(words):
        hit, found = set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if ids := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_decontaminate(spark, docs, texts, block_bytes):
    w = texts[0].split()
    items = [(1, " ".join(w[:14]).upper()), (10, " ".join(texts[-4].split()[50:75])), (2, "one"), (3, "one two"), (4, None), (5, "..."), (None, " ".join(w[2:13])), (7, "not anywhere at all in these texts of ours today ok then")]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = by_id(decontaminate.decontaminate(docs, bench, block_bytes=block_bytes), "n_words", "n_hit", "items")
    want = brute_contamination(texts, items)
    assert {k: (a, b, list(c)) for k, (a, b, c) in got.items()} == want
    assert any(x[1] for x in want.values())


def test_decontaminate_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 and not r["items"] for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.decontaminate(no_docs, none).count() == 0


def brute_lines(texts, ids, min_chars=40, min_docs=5):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    last, n = {}, Counter()
    for i, t in zip(ids, texts, strict=True):
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] += 1
            last[k] = max(last.get(k, -1), i)
    out = {}
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and n[key(x)] >= min_docs and last[key(x)] != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
@pytest.mark.parametrize("sizes", [(40, 5, 50_000), (1, 2, 2)])
def test_line_dedup(docs, texts, broadcast_bytes, sizes):
    chars, n, per_shard = sizes
    got = by_id(line_dedup.line_dedup(docs, chars, n, per_shard, broadcast_bytes, salts=3), "n_lines", "n_dropped", "kept")
    want = brute_lines(texts, range(len(texts)), chars, n)
    assert got == want
    assert sum(x[1] for x in want.values()) > 3


def test_perfect_hash_is_minimal():
    """Also of keys that agree in one of their halves."""
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(2))
    h2[:50], h1[50:90] = 7, 9
    shard = line_dedup.build_shard(h1, h2, np.ones(len(h1), np.int32), np.arange(len(h1)))
    at = line_dedup.shard_index(shard, h1, h2)
    assert sorted(at.tolist()) == list(range(len(h1))) and (shard["last"][at] == np.arange(len(h1))).all()
    with pytest.raises(ValueError):
        line_dedup.build_shard(h1[[0, 0]], h2[[0, 0]], np.ones(2, np.int32), np.arange(2))


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [64, 1, 0])
def test_simhash(docs, texts, bucket_rows):
    got = by_id(simhash_dedup.near_duplicates(docs, bucket_rows=bucket_rows), "fp", "component_id")
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i][0] & ((1 << 64) - 1) for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == brute_components(fps, 2)


@pytest.mark.parametrize("bucket_rows", [64, 0])
@pytest.mark.parametrize("max_bits", [2, 3, 6])
def test_simhash_links(spark, max_bits, bucket_rows):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    for x in list(fps):
        for _ in range(4):
            y = fps[-1] if rng.random() < 0.3 else x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            fps.append(y - (1 << 64) if y >= 1 << 63 else y)
    fps = sorted({(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash_dedup.links(df, max_bits, bucket_rows).collect()]
    at = {x: i for i, x in enumerate(fps)}
    linked = {(x, y) for x, y in edges}
    assert all(((x ^ y) & ((1 << 64) - 1)).bit_count() <= max_bits for x, y in linked)
    roots = list(range(len(fps)))
    for _ in range(len(fps)):
        for x, y in linked:
            roots[at[x]] = roots[at[y]] = min(roots[at[x]], roots[at[y]])
    assert roots == brute_components([x & ((1 << 64) - 1) for x in fps], max_bits)


def test_thresholds_for_many_fingerprints():
    sample = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 500)
    together = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (10**3, 10**6, 10**9, 10**12):
        parts = pigeonhole.allocate(sample, together * n, n, 2)
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
    few, many = (pigeonhole.allocate(sample, together * n, n, 2) for n in (10**3, 10**11))
    assert [t for _, t in few] == [0, 0, 0] and sum(t for _, t in many) >= 1


def brute_substrings(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = [True] * n
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1}, {"hot_rows": 3, "seen_rows": 2, "chunk_windows": 50, "table_bits": 20}, {"table_bits": 8}, {"hot_rows": 2, "table_bits": 4, "piece": 300}, {"piece": 150}])
def test_substrings(docs, texts, options, monkeypatch):
    """Also with tables that are too full, so that anchors are joined, and with texts cut into small pieces."""
    options = dict(options)
    monkeypatch.setattr(substring_dedup, "PIECE", options.pop("piece", 1 << 20))
    got = by_id(substring_dedup.substring_dedup(docs, **options), "n_bytes", "n_removed", "n_spans", "kept")
    want = brute_substrings(texts)
    assert [(a, b, c, bytes(d)) for a, b, c, d in (got[i] for i in range(len(texts)))] == want
    assert sum(x[1] for x in want) > 1000


def test_substrings_beyond_a_piece(spark):
    """A passage at both ends of a text of several pieces, and over a cut."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.choice(list(b"abcdefghij "), n).astype(np.uint8).tobytes().decode()
    passage, n = letters(500), substring_dedup.PIECE
    texts = [letters(999) + "A" + passage + "B" + letters(n - 1702) + "C" + passage[:300] + "D" + letters(2 * n) + "E" + passage, passage, letters(299) + "F" + passage[100:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(docs), "n_bytes", "n_removed", "n_spans")
    assert got == {0: (len(texts[0]), 800, 2), 1: (500, 500, 1), 2: (600, 300, 1)}


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    suffixes, group = rng.integers(97, 99, (60, 21)).astype(np.uint8), np.sort(rng.integers(0, 3, 60))
    suffixes[30:40] = suffixes[:10]
    shared = lambda a, b: next((k for k in range(21) if a[k] != b[k]), 21)
    want = [max([shared(suffixes[i], suffixes[j]) for j in range(i) if group[j] == group[i]], default=0) for i in range(60)]
    assert substring_dedup.longest_previous_factors(group, suffixes).tolist() == want


def test_previous_smaller():
    v = np.random.default_rng(2).permutation(500)
    want = [max([j for j in range(i) if v[j] < v[i]], default=-1) for i in range(500)]
    assert substring_dedup.previous_smaller(v).tolist() == want


def naive_forward_backward(start, move, emit, x):
    """Gammas, expected moves and log10 of the likelihood of one sequence, step by step over the whole of it."""
    alpha, scale = [], []
    for t, symbol in enumerate(x):
        a = (start if t == 0 else alpha[-1] @ move) * emit[symbol]
        scale.append(a.sum())
        alpha.append(a / a.sum())
    beta, moves = np.ones(len(start)), np.zeros((len(start), len(start)))
    gammas = [alpha[-1]]
    for t in range(len(x) - 2, -1, -1):
        ahead = emit[x[t + 1]] * beta / scale[t + 1]
        moves += np.outer(alpha[t], ahead) * move
        beta = move @ ahead
        gammas.append(alpha[t] * beta)
    return gammas[::-1], moves, float(np.log10(scale).sum())


@pytest.mark.parametrize("own_symbols", [1 << 16, 20])
def test_hmm_scores(docs, texts, own_symbols):
    """All numbers, the model's score too, against a plain model trained text by text."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(t for own, h in zip(tokens, held, strict=True) if not h for t in own)
    n, v = sum(c.values()), len(c)
    sizes = Counter(x.bit_length() - 1 for x in c.values())
    least = 1 << min((b for b in sizes if sum(k for a, k in sizes.items() if a >= b) <= own_symbols), default=62)
    one = lambda t: Words([t.encode()], BLANK_SEPARATED)
    code = {t: 0 if t == "\n" else int(one(t).hashes[0]) for own in tokens for t in own}
    kind = {t: int(hmm_lm._classes(one(t))[0]) for t in code if t != "\n"}
    head = sorted(t for t in {"\n", *c} if t == "\n" or c[t] >= least)
    head.sort(key=code.get)
    place = {t: i for i, t in enumerate(head)}
    tail = [t for t in c if t not in place]
    assert bool(tail) == (own_symbols == 20)
    sums, kinds = Counter(), Counter()
    for t in tail:
        sums[kind[t]] += c[t]
        kinds[kind[t]] += 1
    counts = np.array([c[t] for t in head] + [sums[k] for k in range(hmm_lm.CLASSES)], dtype=float)
    x = [[place[t] if t in place else len(head) + kind[t] for t in own] for own in tokens]
    m = hmm_lm.initial(counts, 3)
    start, move, emit = m.start, m.move, m.emit
    for _ in range(2):
        starts, moves, emits = np.full(3, 0.1), np.full((3, 3), 0.1), np.full(emit.shape, 0.01)
        for own, h in zip(x, held, strict=True):
            if not h:
                gammas, more, _ = naive_forward_backward(start, move, emit, own)
                starts, moves = starts + gammas[0], moves + more
                for s, g in zip(own, gammas, strict=True):
                    emits[s] += g
        start, move, emit = starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0)
    got = by_id(hmm_lm.score_texts(docs, fold != 1, states=3, rounds=2, own_symbols=own_symbols), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, own in enumerate(tokens):
        assert got[i][:3] == (len(own), sum(c[t] > 0 for t in own), n)
        assert got[i][3] == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel=1e-9)
        share = sum(log10((c[t] + 0.5) / (sums[kind[t]] + 0.5 * (kinds[kind[t]] + 1))) for t in own if t not in place)
        assert got[i][4] == pytest.approx(naive_forward_backward(start, move, emit, x[i])[2] + share, rel=2e-4)


def test_forward_is_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    s, k = 3, 5
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((k, s)), 0))
    runs = [rng.integers(0, k, n).astype(np.int32) for n in (1, 4, 6, 2)]
    for run, got in zip(runs, hmm_lm.forward(m, runs), strict=True):
        total = 0.0
        for path in product(range(s), repeat=len(run)):
            p = m.start[path[0]] * m.emit[run[0], path[0]]
            for t in range(1, len(run)):
                p *= m.move[path[t - 1], path[t]] * m.emit[run[t], path[t]]
            total += p
        assert got == pytest.approx(np.log10(total), rel=1e-5)


@pytest.mark.parametrize(("longest", "cells"), [(1000, 1 << 18), (4, 1 << 18), (3, 20), (1, 1)])
def test_counts_of_cut_texts_are_those_of_whole_texts(longest, cells):
    rng = np.random.default_rng(6)
    s, k = 3, 7
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((k, s)), 0), np.float64)
    runs = [rng.integers(0, k, n).astype(np.int32) for n in (1, 40, 3, 8, 9, 1, 100, 4)]
    want = [naive_forward_backward(m.start, m.move, m.emit, r) for r in runs]
    emits, by_symbol = np.zeros((k, s)), np.zeros((k, s))
    starts, moves, likelihood = hmm_lm.expected_counts(m, runs, emits, longest, cells)
    for r, (gammas, _, _) in zip(runs, want, strict=True):
        np.add.at(by_symbol, r, gammas)
    assert np.allclose(emits, by_symbol) and np.allclose(moves, sum(w[1] for w in want)) and np.allclose(starts, sum(w[0][0] for w in want))
    assert likelihood == pytest.approx(sum(w[2] for w in want)) and np.allclose(hmm_lm.forward(m, runs, longest, cells), [w[2] for w in want])


def test_likelihood_does_not_fall_and_a_long_text_among_short_ones(spark):
    """A text of a million tokens, many short and empty ones; each round's likelihood is that before it, or more."""
    rng = np.random.default_rng(3)
    topics = [[f"{a}{i}" for i in range(40)] for a in "abc"]
    prose = lambda n: " ".join(w for i in range(0, n, 50) for w in rng.choice(topics[rng.integers(3)], 50))
    rows = [(0, prose(1_000_000)), *((i, prose(50 * int(rng.integers(1, 40)))) for i in range(1, 60)), *((i, "") for i in range(60, 6000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    known = Words([" ".join(w for t in topics for w in t).encode()], BLANK_SEPARATED)
    head = np.unique(np.append(known.hashes, np.uint64(hmm_lm.END)))
    none = np.zeros(hmm_lm.CLASSES)
    coded = hmm_lm.coded_texts(docs.select(F.col("doc_id").alias("rid"), "doc_id", F.lit(True).alias("train"), "text"), head, np.ones(len(head)), none, none).cache()
    model, seen = hmm_lm.initial(np.concatenate([np.ones(len(head)), none]), 3), []
    for _ in range(4):
        model, likelihood = hmm_lm.baum_welch(coded, model)
        seen.append(likelihood)
    assert all(b >= a * (1 + 1e-6) for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]
    scores = by_id(hmm_lm.score_texts(docs, F.lit(True), states=3, rounds=1), "n_tokens", "score")
    assert scores[0][0] == 1_000_001 and all(np.isfinite(s) for _, s in scores.values())


def test_toxicity_learns_pairs_and_handles_no_labels(spark, docs, no_docs):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(10)] + ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(own, known, learn_from=F.col("doc_id") % 4 != 0), "score")
    right = sum((got[i][0] >= 0.5) == bool(t) for i, _, t in labels if i % 4 == 0)
    assert right >= 97
    none = known.limit(0)
    assert all(r["score"] < 1e-6 for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(no_docs, known).count() == 0


def test_toxicity_of_a_pair_whose_parts_say_nothing(spark):
    """Exactly one of two words makes a text toxic: no additive model of the words can be right in more than three of four cases."""
    import random

    rng = random.Random(2)
    rows, labels = [], []
    filler = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    for i in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(30)] + ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult != group)))
    own, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(own, known, learn_from=F.col("doc_id") % 4 != 0), "score")
    assert sum((got[i][0] >= 0.5) == bool(t) for i, t in labels if i % 4 == 0) >= 480


def test_margins_are_the_sum_over_pairs():
    from itertools import combinations

    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    docs = [[0, 3, 8], [], [5], [1, 2, 4, 6, 7]]
    pairs = [(i, t) for i, own in enumerate(docs) for t in own]
    got = m.margins(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), len(docs))
    want = [0.3 + sum(m.w[t] for t in own) + sum(m.v[a] @ m.v[b] for a, b in combinations(own, 2)) for own in docs]
    assert np.allclose(got, want)


def test_toxicity_scores_whole_long_texts_and_rows_of_null_ids(spark, odd_docs):
    rows = [(i, f"clean words number {i}" if i % 2 else f"nastyword here {i}") for i in range(200)]
    rows += [(200, "plain " * 500_000 + "nastyword"), (201, "plain " * 500_000)]
    own, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    machine = toxicity.train(toxicity.labelled_sample(own, known))
    got = by_id(toxicity.score(own, machine), "score")
    assert got[200][0] > 0.5 > got[201][0]
    odd = toxicity.score(odd_docs, machine).collect()
    assert len(odd) == 5 and sorted(r["doc_id"] or -1 for r in odd) == [-1, -1, -1, 3, 3] and len({round(r["score"], 9) for r in odd}) == 1


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    runs = [
        lambda d: bpe_codec.digests(bpe_codec.encode(d, RANKS, public_tokenizers.PATTERN)),
        lambda d: token_counts.token_counts(d, JSON),
        lambda d: decontaminate.decontaminate(d, bench),
        lambda d: line_dedup.line_dedup(d, 1, 2),
        lambda d: line_dedup.line_dedup(d, 1, 2, broadcast_bytes=0),
        lambda d: simhash_dedup.near_duplicates(d),
        lambda d: substring_dedup.substring_dedup(d),
        lambda d: hmm_lm.score_texts(d, fold != 1, states=2, rounds=1),
    ]
    for f in runs:
        rows = f(odd_docs).collect()
        assert len(rows) == 5 and sorted(r["doc_id"] or -1 for r in rows) == [-1, -1, -1, 3, 3]
        assert f(no_docs).count() == 0
    assert all(r["component_id"] == 3 for r in simhash_dedup.near_duplicates(odd_docs).collect() if r["fp"])


def test_digest_of_ids(docs):
    r = bpe_codec.digests(bpe_codec.encode(docs.where("doc_id = 5"), RANKS, public_tokenizers.PATTERN)).first()
    ids = bpe_codec.encode(docs.where("doc_id = 5"), RANKS, public_tokenizers.PATTERN).first()["ids"]
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
