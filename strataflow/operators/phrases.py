"""Conversion of texts by a table of phrases that the user gives, such as from traditional to simplified characters.

At each place the longest phrase that begins there is replaced, so that a character with several counterparts is settled by the
phrase that it stands in; what no phrase covers stays. The table is broadcast after its size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast.
MOST_PHRASES = 1_000_000


class Phrases:
    """Phrases by their first character, and the lengths that those of each have, longest first."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        lengths: dict[str, set[int]] = {}
        for phrase in table:
            lengths.setdefault(phrase[0], set()).add(len(phrase))
        self.lengths = {c: sorted(own, reverse=True) for c, own in lengths.items()}

    def convert(self, text: str) -> str:
        out, at, plain = [], 0, 0
        while at < len(text):
            for n in self.lengths.get(text[at], ()):
                new = self.table.get(text[at : at + n])
                if new is not None:
                    out += [text[plain:at], new]
                    at += n
                    plain = at
                    break
            else:
                at += 1
        return "".join([*out, text[plain:]])


def phrase_table(mapping: DataFrame) -> DataFrame:
    """``source, target`` with a row for each source: of several targets the least; empty sources and null targets are left out."""
    return mapping.where((F.length("source") > 0) & F.col("target").isNotNull()).groupBy("source").agg(F.min("target").alias("target"))


def converter(mapping: DataFrame) -> Callable[[Column], Column]:
    """A function of a text column; mapping: ``source, target``. Null stays null."""
    table = phrase_table(mapping).select("source", "target").limit(MOST_PHRASES + 1).toArrow()
    if table.num_rows > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases; no more are broadcast")
    held = mapping.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(held.value)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else phrases.convert(t))

    return lambda text: convert(text)
