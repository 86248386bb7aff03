"""Whole numbers written in digits, in English or Chinese words or as Roman numerals.

Each reader takes a word apart and is held against the writer: what the writer wouldn't write is no number.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The words and signs of numbers.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"trillion": 10**12, "billion": 10**9, "million": 10**6, "thousand": 10**3}
HAN = "零一二三四五六七八九"
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
HAN_SCALES = {"亿": 10**8, "万": 10**4}
VARIANTS = str.maketrans("〇○两兩壹贰貳叁參肆伍陆陸柒捌玖拾佰仟萬億", "零零二二一二二三三四五六六七八九十百千万亿")
SHORT_TENS = {"廿": "二十", "卅": "三十", "卌": "四十"}
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
LARGEST = (1 << 63) - 1


def in_english(n: int) -> list[str]:
    """The words of a number below 10 ** 15."""
    if n < 20:
        return [ONES[n]]
    if n < 100:
        return [TENS[n // 10 - 2], *([ONES[n % 10]] if n % 10 else [])]
    if n < 1000:
        return [ONES[n // 100], "hundred", *(in_english(n % 100) if n % 100 else [])]
    scale = next(s for s, value in SCALES.items() if n >= value)
    more, rest = divmod(n, SCALES[scale])
    return [*in_english(more), scale, *(in_english(rest) if rest else [])]


def from_english(word: str) -> int | None:
    """``and`` may stand behind a hundred and before the last words; a hundred or thousand of nothing is one."""
    words = re.split(r"[\s-]+", word.lower())
    said = [w for i, w in enumerate(words) if w != "and" or not 0 < i < len(words) - 1 or words[i - 1] not in ("hundred", *SCALES)]
    if said and said[0] in ("hundred", *SCALES):
        said = ["one", *said]
    total, part = 0, 0
    for w in said:
        if w in SCALES:
            total, part = total + part * SCALES[w], 0
        elif w == "hundred":
            part *= 100
        elif w in ONES or w in TENS:
            part += ONES.index(w) if w in ONES else 10 * (TENS.index(w) + 2)
        else:
            return None
    return total + part if total + part < 10**15 and in_english(total + part) == said else None


def in_chinese(n: int) -> str:
    """With a one before ten."""
    if n < 10:
        return HAN[n]
    sign, value = next((s, v) for s, v in [*HAN_SCALES.items(), *reversed(HAN_UNITS.items())] if n >= v)
    more, rest = divmod(n, value)
    # A zero tells that places are left out.
    return in_chinese(more) + sign + ("" if not rest else in_chinese(rest) if 10 * rest >= value else "零" + in_chinese(rest))


def from_chinese(word: str) -> int | None:
    said = re.sub("[廿卅卌]", lambda m: SHORT_TENS[m[0]], word).translate(VARIANTS)
    if not said or set(said) - set(HAN) - HAN_UNITS.keys() - HAN_SCALES.keys():
        return None
    if not set(said) - set(HAN):
        return int("".join(str(HAN.index(c)) for c in said)) if len(said) < 19 else None  # digit by digit
    total, part, digit = 0, 0, 0
    for c in said:
        if c in HAN:
            digit = HAN.index(c)
        elif c in HAN_UNITS:
            part, digit = part + (digit or 1) * HAN_UNITS[c], 0
        elif c == "万":
            total, part, digit = total + (part + digit) * HAN_SCALES[c], 0, 0
        else:
            total, part, digit = (total + part + digit) * HAN_SCALES[c], 0, 0
    n = total + part + digit
    # The one before ten may be left out at the front; where it stands inside, both ways are usual.
    plain = lambda x: re.sub("(?<![二三四五六七八九])一?十", "十", x)
    return n if n <= LARGEST and plain(in_chinese(n)) == plain(said) else None


def in_roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def from_roman(word: str) -> int | None:
    """From 1 to 3999."""
    if not re.fullmatch("[IVXLCDM]{1,15}", word):
        return None
    values = [dict((s, v) for v, s in ROMAN)[c] for c in word]
    n = sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))
    return n if 0 < n < 4000 and in_roman(n) == word else None


@lru_cache(1 << 16)
def whole_number(word: str) -> int:
    """The number, or -1."""
    said = word.strip()
    if re.fullmatch(r"[+-]?[0-9]+", said):
        n = int(said) if len(said) < 20 else LARGEST + 1
        return n if abs(n) <= LARGEST else -1
    for read in (from_english, from_chinese, from_roman):
        if (found := read(said)) is not None:
            return found
    return -1


@F.pandas_udf(LongType())
def _numbers(words: pd.Series) -> pd.Series:
    return words.map(lambda w: -1 if w is None else whole_number(w)).astype("int64")


def number(word: Column) -> Column:
    """The same for a column; null is -1."""
    return _numbers(word)
