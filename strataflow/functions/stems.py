"""English stems by Porter's algorithm of 1980, as published."""

from __future__ import annotations

import re
from functools import lru_cache

# The rules of the published steps 2 to 4, as (ending, what takes its place).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` for each vowel, ``c`` for others; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel and consonant, the last no w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """By the rule of the longest ending that matches, if what stands before it is long enough."""
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending):
            before = word[: -len(ending)]
            good = measure(before) > least and (ending != "ion" or before[-1:] in ("s", "t"))
            return before + new if good else word
    return word


def _plurals(word: str) -> str:
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            return word[: -len(ending)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        before = word[: -len(ending)]
        if word.endswith(ending):
            if "v" not in _shape(before):
                return word
            if before.endswith(("at", "bl", "iz")):
                return before + "e"
            if _doubled(before) and before[-1] not in "lsz":
                return before[:-1]
            return before + "e" if measure(before) == 1 and _short(before) else before
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        before = word[:-1]
        if measure(before) > 1 or measure(before) == 1 and not _short(before):
            word = before
    return word[:-1] if measure(word) > 1 and word.endswith("ll") else word


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """Words of lower-case English letters; others, and those of two letters, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2, 0), STEP3, 0)
    return _final(_replaced(word, tuple((e, "") for e in STEP4), 1))
