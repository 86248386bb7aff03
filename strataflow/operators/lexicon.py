"""Words of Chinese text by a dictionary that the user gives as a table."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stem
from ..functions.text import half_width

# A frequency of one, what an unknown piece weighs, and the pattern of what separates runs of text.
DENOMINATOR, UNKNOWN = 1_000_000, -12
SEPARATORS = r"([ ,\.<>/?;:'\[\]\\`!@#$%^&*\(\)\{\}\|_+=《》，。？、；‘’：“”【】~！￥%……（）——-]+|[a-zA-Z0-9,\.-]+)"
#: A dictionary is broadcast: so many terms at most (some 100 bytes each in a task).
MOST_TERMS = 2_000_000


def lexicon(words: DataFrame) -> DataFrame:
    """``term, weight, tag`` of ``term, freq, tag``: the frequency's logarithm as a whole number; of several rows of a term the greatest."""
    weight = (F.ln(F.col("freq") / DENOMINATOR) + 0.5).cast("int")
    best = words.where(F.col("freq") > 0).groupBy("term").agg(F.max(F.struct(weight.alias("weight"), "tag")).alias("b"))
    return best.select("term", "b.weight", "b.tag")


def frequencies(terms: DataFrame, known: DataFrame) -> DataFrame:
    """terms (``term``) with ``freq, tag`` as the dictionary's weights give them; 0 and an empty tag where it lacks a term."""
    freq = F.floor(F.exp("weight") * DENOMINATOR + 0.5).cast("long")
    return terms.join(known, "term", "left").select(*terms.columns, F.coalesce(freq, F.lit(0)).alias("freq"), F.coalesce("tag", F.lit("")).alias("tag"))


def _lengths(words: dict[str, int], at: int) -> dict[str, tuple[int, ...]]:
    """The lengths of words of two characters and more by two characters from a place on."""
    out: dict[str, set[int]] = {}
    for w in words:
        if len(w) > 1:
            out.setdefault(w[at:][:2], set()).add(len(w))
    return {k: tuple(sorted(v)) for k, v in out.items()}


class Words:
    """A dictionary in a task."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        # The lengths of words by their first and by their last two characters, the shortest first.
        self.ahead, self.behind = _lengths(weights, 0), _lengths(weights, -2)
        self.finer = lru_cache(1 << 15)(self._finer)

    def forward(self, text: str) -> list[tuple[int, int]]:
        """From the left, the longest word at each place, or one character."""
        out, at = [], 0
        while at < len(text):
            end = next((at + n for n in reversed(self.ahead.get(text[at : at + 2], ())) if text[at : at + n] in self.weights and at + n <= len(text)), at + 1)
            out.append((at, end))
            at = end
        return out

    def backward(self, text: str) -> list[tuple[int, int]]:
        """From the right, the longest word that ends at each place, or one character."""
        out, end = [], len(text)
        while end:
            at = next((end - n for n in reversed(self.behind.get(text[max(0, end - 2) : end], ())) if n <= end and text[end - n : end] in self.weights), end - 1)
            out.append((at, end))
            end = at
        return out[::-1]

    def edges(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, weight) of the pieces that may begin at a place: words, an unknown character where there is none, or up to 10 equal ones of 5 and more."""
        if text[at] == text[at + 1 : at + 2] and text[at : at + 5] == 5 * text[at]:
            end = at + 5
            while end < min(len(text), at + 10) and text[end] == text[at]:
                end += 1
            return [(end, self.weights.get(text[at:end], UNKNOWN))]
        lengths = (1, *self.ahead.get(text[at : at + 2], ()))
        found = [(at + n, w) for n in lengths if at + n <= len(text) and (w := self.weights.get(text[at : at + n])) is not None]
        return found or [(at + 1, UNKNOWN)]

    def paths(self, text: str) -> list[list[tuple[int, int]]]:
        """All ways to split a short text, those of shorter first words first."""
        if not text:
            return [[]]
        out: list[list[tuple[int, int]]] = []

        def walk(at: int, path: list[tuple[int, int]]) -> None:
            if at == len(text):
                out.append(path)
            for end, _ in self.edges(text, at) if at < len(text) else ():
                walk(end, [*path, (at, end)])

        walk(0, [])
        return out

    def score(self, text: str, path: list[tuple[int, int]]) -> float:
        """30 by the number of pieces, the share of those of two characters and more, and the pieces' weights."""
        weights = sum(self.weights.get(text[a:b], UNKNOWN) for a, b in path)
        return 30 / len(path) + sum(b - a > 1 for a, b in path) / len(path) + weights

    def best(self, text: str) -> list[tuple[int, int]]:
        """The way to split a text of any length that has the highest score; of equal ones that with the longest last pieces.

        Weights are whole numbers, and what the score adds to them is 1 + 30 by the fewest pieces at most: so little can the best way lack of the
        greatest weight. For each lack the greatest quotient, 30 and the longer pieces by all pieces, is found by Dinkelbach's method: ways of the
        greatest ``q * long - p * pieces``, p / q being the quotient to surpass, until none does. Few steps are needed, and each is linear in the text.
        """
        if not text:
            return []
        size = len(text)
        # By place: the pieces that end there (``_gains``), the greatest weight so far and the fewest pieces so far.
        into: list[list[tuple[int, int, bool]]] = [[] for _ in range(size + 1)]
        top: list[int | None] = [0, *[None] * size]
        fewest = [0, *[size] * size]
        for at, so_far in enumerate(top):
            if so_far is None:
                continue
            into[at] = [(begin, so_far - weight, long) for begin, weight, long in into[at]]
            for end, w in self.edges(text, at) if at < size else ():
                weight, known = so_far + w, top[end]
                into[end].append((at, weight, end - at > 1))
                if known is None or weight > known:
                    top[end] = weight
                if fewest[at] + 1 < fewest[end]:
                    fewest[end] = fewest[at] + 1
        # num / den: what the best way so far has beyond the greatest weight.
        num, den, best, lack = 0, 1, [], 0
        while (num + lack * den) * fewest[-1] <= (30 + fewest[-1]) * den:
            p, q = num + lack * den, den
            gains = _gains(into, lack, p, q)
            over = gains[-1][lack] + 30 * q
            way = _traced(into, gains, p, q) if over >= 0 else []
            if over > 0:
                best, den = way, len(way)
                num = 30 + sum(b - a > 1 for a, b in way) - lack * den
            else:
                best = min(best, way) if way else best
                lack += 1
        return best[::-1]

    def split(self, text: str) -> list[str]:
        """Pieces on which both directions agree, and the best ways to split the stretches between them."""
        ahead, back = self.forward(text), set(self.backward(text))
        out, at = [], 0
        for a, b in [p for p in ahead if p in back] + [(len(text), len(text))]:
            if at < a:
                out += [text[at + s : at + e] for s, e in self.best(text[at:a])]
            if a < b:
                out.append(text[a:b])
            at = b
        return out

    def merged(self, tokens: list[str]) -> list[str]:
        """Up to five tokens whose concatenation has a separator, a Latin letter or a digit and is a word become one."""
        out, at = [], 0
        while at < len(tokens):
            joined = [e for e in range(at + 2, min(len(tokens), at + 5) + 1) if (t := "".join(tokens[at:e])) in self.weights and re.search(SEPARATORS, t)]
            end = joined[-1] if joined else at + 1
            out.append("".join(tokens[at:end]))
            at = end
        return out

    def _finer(self, token: str) -> list[str]:
        """The second best way to split a token of 3 to 10 characters that isn't a number."""
        if not 3 <= len(token) <= 10 or re.fullmatch(r"[0-9,.\-]+", token):
            return [token]
        ways = sorted(self.paths(token), key=lambda p: -self.score(token, p))
        if len(ways) < 2 or len(ways[1]) == len(token):
            return [token]
        pieces = [token[a:b] for a, b in ways[1]]
        return [token] if re.fullmatch(r"[a-z.\-]+", token) and min(map(len, pieces)) < 3 else pieces


def _gains(into: list[list[tuple[int, int, bool]]], most: int, p: int, q: int) -> list[list[float]]:
    """For each place and each lack of weight up to most, the greatest ``q * long - p * pieces`` of the ways there.

    into: by place, the pieces that end there as (begin, lack of weight, whether longer than a character).
    """
    out: list[list[float]] = [[0] + [-math.inf] * most]
    for pieces in into[1:]:
        own = [-math.inf] * (most + 1)
        for at, lack, long in pieces:
            gain, before = q * long - p, out[at]
            for k in range(lack, most + 1):
                if before[k - lack] + gain > own[k]:
                    own[k] = before[k - lack] + gain
        out.append(own)
    return out


def _traced(into: list[list[tuple[int, int, bool]]], gains: list[list[float]], p: int, q: int) -> list[tuple[int, int]]:
    """The pieces, the last first, of a way that has the greatest gain at the greatest lack; of several that with the longest last pieces."""
    out, end, lack = [], len(into) - 1, len(gains[0]) - 1
    while end:
        at, less = next((at, less) for at, less, long in into[end] if less <= lack and gains[at][lack - less] + q * long - p == gains[end][lack])
        out.append((at, end))
        end, lack = at, lack - less
    return out


_RUN = re.compile(r"[一-龥]+|[^一-龥\s]+")


def tokenize(words: Words, text: str) -> list[str]:
    """Runs of Chinese characters as words of the dictionary, others between white space by their stems."""
    out: list[str] = []
    for run in _RUN.findall(text):
        out += words.split(run) if "一" <= run[0] <= "龥" and len(run) > 1 else [stem(run)]
    return words.merged(out)


def fine_grained(words: Words, tokens: list[str]) -> list[str]:
    """Finer tokens; where under a fifth begins with a Chinese character only slashes separate."""
    if sum("一" <= t[0] <= "龥" for t in tokens if t) < len(tokens) * 0.2:
        return [p for t in tokens for p in t.split("/")]
    return [p for t in tokens for p in words.finer(t)]


def segmented(rows: DataFrame, key: list[str], text: str, known: DataFrame, convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, ``words, fine_words`` (arrays) of each row's text: in half width and lower case, what is no letter or digit as white space.

    known: ``term, weight`` as ``lexicon`` has them, in whole numbers; it is broadcast, and refused beyond MOST_TERMS. convert: what becomes of the
    text then, such as ``phrases.converter`` to simplified characters. Null text: no words.
    """
    n = known.count()
    if n > MOST_TERMS:
        raise ValueError(f"a dictionary of {n} terms; at most {MOST_TERMS} are broadcast")
    table = known.select("term", "weight").toArrow()
    held = rows.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind = Words(held.value), pa.list_(pa.string())
        for batch in batches:
            own = [tokenize(words, t or "") for t in batch.column(len(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(own, kind), pa.array([fine_grained(words, o) for o in own], kind)], names=[*key, "words", "fine_words"])

    plain = F.lower(half_width(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+", " ")))
    plain = (convert(plain) if convert else plain).alias("_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return rows.select(*key, plain).mapInArrow(run, f"{schema}, words array<string>, fine_words array<string>")


def weight_of(freq: float) -> int:
    """A frequency's weight, as ``lexicon`` has it."""
    return math.trunc(math.log(freq / DENOMINATOR) + 0.5)
