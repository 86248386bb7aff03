"""Tokenizers for indexes: words of Chinese text by the most probable path and a tagger, English words by their stems.

A tokenizer takes a text column to an array column of words; ``retrieval`` and ``Engine`` take one. The dictionary and the tagger's
counts are tables, aggregated by Spark and broadcast after their size is checked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stem
from ..functions.text import half_width

Tokenizer = Callable[[Column], Column]

#: A dictionary and the characters that a tagger knows are broadcast: so many rows at most.
MOST_TERMS, MOST_CHARACTERS = 2_000_000, 400_000
#: Logarithms are whole numbers of this part of one, so that sums and ties don't depend on their order.
UNIT = 1_000_000
NEVER = -(1 << 50)
TAGS = "BMES"
#: Which tags may follow a tag: a word's begin, middle and end, or a single character.
FOLLOWING = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
_HAN = re.compile(r"[一-鿿]+|[^\W_一-鿿]+")


def log_share(n: float, total: float) -> int:
    return round(UNIT * math.log(n / total))


def dictionary(words: DataFrame) -> DataFrame:
    """``term, freq`` of rows ``term, freq``: frequencies of a term summed, empty terms and those without a frequency left out."""
    return words.where((F.length("term") > 0) & (F.col("freq") > 0)).groupBy("term").agg(F.sum("freq").cast("double").alias("freq"))


def tag_counts(segmented: DataFrame) -> DataFrame:
    """``kind, a, b, n`` of rows ``words array<string>``: how often a tag begins a text (``start``), follows another (``next``) and has a character (``sign``)."""
    middle = F.lit("M")
    tags_of = lambda w: F.when(F.length(w) == 1, "S").otherwise(F.concat(F.lit("B"), F.repeat(middle, F.length(w) - 2), F.lit("E")))
    words = F.filter("words", lambda w: F.length(w) > 0)
    rows = segmented.select(F.array_join(words, "").alias("text"), F.array_join(F.transform(words, tags_of), "").alias("tags")).where(F.length("text") > 0)
    start = rows.groupBy(F.lit("start").alias("kind"), F.substring("tags", 1, 1).alias("a"), F.lit("").alias("b")).agg(F.count("*").alias("n"))
    places = rows.select("text", "tags", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    at = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    signs = places.groupBy(F.lit("sign").alias("kind"), at("tags", F.col("i")).alias("a"), at("text", F.col("i")).alias("b")).agg(F.count("*").alias("n"))
    pairs = places.where(F.col("i") > 1).groupBy(F.lit("next").alias("kind"), at("tags", F.col("i") - 1).alias("a"), at("tags", F.col("i")).alias("b")).agg(F.count("*").alias("n"))
    return start.unionByName(pairs).unionByName(signs)


@dataclass(frozen=True)
class Tagger:
    """Logarithms of a hidden Markov model's probabilities; characters that a tag never had share what one more would have."""

    start: dict[str, int]
    following: dict[tuple[str, str], int]
    signs: dict[tuple[str, str], int]
    unseen: dict[str, int]

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str, int]]) -> Tagger:
        counts: dict[str, dict[tuple[str, str], int]] = {"start": {}, "next": {}, "sign": {}}
        for kind, a, b, n in rows:
            counts[kind][a, b] = n
        first = {t: counts["start"].get((t, ""), 0) + 1 for t in "BS"}
        start = {t: log_share(n, sum(first.values())) for t, n in first.items()}
        following, signs, unseen = {}, {}, {}
        for a in TAGS:
            own = {b: counts["next"].get((a, b), 0) + 1 for b in FOLLOWING[a]}
            following |= {(a, b): log_share(n, sum(own.values())) for b, n in own.items()}
            total = sum(n for (t, _), n in counts["sign"].items() if t == a) + 1
            signs |= {(t, c): log_share(n, total) for (t, c), n in counts["sign"].items() if t == a}
            unseen[a] = log_share(1, total)
        return cls(start, following, signs, unseen)

    def tags(self, text: str) -> str:
        """The most probable tags, which end a word at the end; of equal ones those that come first in TAGS, from the end on."""
        best, back = {t: (self.start.get(t, NEVER) + self.signs.get((t, text[0]), self.unseen[t])) for t in TAGS}, []
        for c in text[1:]:
            ways = {t: max(((best[a] + self.following[a, t], -TAGS.index(a), a) for a in TAGS if t in FOLLOWING[a])) for t in TAGS}
            back.append({t: w[2] for t, w in ways.items()})
            best = {t: w[0] + self.signs.get((t, c), self.unseen[t]) for t, w in ways.items()}
        out = max("ES", key=lambda t: (best[t], -TAGS.index(t)))
        for step in reversed(back):
            out += step[out[-1]]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        out, at = [], 0
        for i, tag in enumerate(self.tags(text), 1):
            if tag in "ES":
                out.append(text[at:i])
                at = i
        return out


class Graph:
    """A prefix dictionary: every word's weight, and every beginning of one."""

    def __init__(self, freq: dict[str, float]):
        total = sum(freq.values()) or 1.0
        self.weights = {t: log_share(n, total) for t, n in freq.items()}
        self.unknown = min(log_share(1, total), 0) if total > 1 else -UNIT
        self.prefixes = {t[:i] for t in freq for i in range(1, len(t) + 1)}

    def ends(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, weight) of the words that begin at a place; a single character is one, known or not."""
        out, end = [(at + 1, self.weights.get(text[at], self.unknown))], at + 1
        while end <= len(text) and text[at:end] in self.prefixes:
            if end > at + 1 and text[at:end] in self.weights:
                out.append((end, self.weights[text[at:end]]))
            end += 1
        return out

    def path(self, text: str) -> list[str]:
        """The words of the most probable way to split a text; of equal ones that with the longest words first."""
        best: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        for at in range(len(text) - 1, -1, -1):
            best[at] = max((w + best[end][0], end) for end, w in self.ends(text, at))
        out, at = [], 0
        while at < len(text):
            out.append(text[at : best[at][1]])
            at = best[at][1]
        return out


def split(graph: Graph, tagger: Tagger | None, text: str) -> list[str]:
    """The words of a run of Chinese characters: the tagger splits stretches of single characters that are no word together."""
    out, single = [], ""
    for word in [*graph.path(text), ""]:
        if len(word) == 1:
            single += word
            continue
        if single:
            out += tagger.words(single) if tagger and len(single) > 1 and single not in graph.weights else list(single)
            single = ""
        out += [word] if word else []
    return out


def words_of(graph: Graph, tagger: Tagger | None, text: str, stems: bool) -> list[str]:
    """Chinese runs split, other runs of letters and digits as they are, or by their stems."""
    out: list[str] = []
    for run in _HAN.findall(text):
        if "一" <= run[0] <= "鿿":
            out += split(graph, tagger, run)
        else:
            out.append(stem(run) if stems else run)
    return out


def _collected(table: DataFrame, most: int, what: str) -> list[tuple]:
    n = table.count()
    if n > most:
        raise ValueError(f"{what} of {n} rows; at most {most} are broadcast")
    return [tuple(r) for r in table.collect()]


def segmenter(words: DataFrame, tags: DataFrame | None = None, stems: bool = False, convert: Callable[[Column], Column] = lambda text: text) -> Tokenizer:
    """A tokenizer by a dictionary (``term, freq``) and, for what it lacks, a tagger (``tag_counts``); texts are folded to half width and lower case, then converted (``phrases.converter``)."""
    freq = dict(_collected(dictionary(words), MOST_TERMS, "a dictionary"))
    counts = None if tags is None else _collected(tags.select("kind", "a", "b", "n"), 4 * MOST_CHARACTERS, "counts of tags")
    held = words.sparkSession.sparkContext.broadcast((freq, counts))

    @F.pandas_udf("array<string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, rows = held.value
        graph, tagger = Graph(own), None if rows is None else Tagger.of(rows)
        for texts in batches:
            yield texts.map(lambda t: words_of(graph, tagger, t, stems))

    return lambda text: segment(convert(F.lower(half_width(F.coalesce(text, F.lit(""))))))


def stemmed(tokenize: Tokenizer) -> Tokenizer:
    """A tokenizer whose words are stems."""

    @F.pandas_udf("array<string>")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda own: [] if own is None else [stem(w) for w in own])

    return lambda text: stems(tokenize(text))
