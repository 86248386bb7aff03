"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the usual Unicode definition has it, and the delimiters of the chunker.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DELIMITERS = "\n。；！？"
MISSING_CELL = "未提供"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean(text: Column) -> Column:
    return collapse(F.regexp_replace(text, CONTROL, ""))


def embedding_input(text: Column, max_tokens: int = 512) -> Column:
    return F.substring(collapse(text), 1, 2 * max_tokens)


def token_count(text: Column) -> Column:
    """Half the characters, rounded down; the count that needs no vocabulary."""
    return F.floor(F.length(text) / 2).cast("long")


def half_width(text: Column) -> Column:
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def english_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^`a-zA-Z0-9.,':;/\"?<>!()\-]", "")) / F.nullif(F.length(text), F.lit(0))


def items_are_english(items: Column) -> Column:
    """Whether more than 0.8 of an array's items are one Latin letter, digit or sign; longer items never are."""
    one = F.size(F.filter(items, lambda x: F.trim(x).rlike(r"^[`a-zA-Z0-9.,':;/\"?<>!()\-]$")))
    return F.coalesce((F.size(items) > 0) & (one / F.size(items) > 0.8), F.lit(False))


def is_english(text: Column) -> Column:
    return F.coalesce(english_share(text) > 0.8, F.lit(False)) & (F.length(text) > 0)


def is_chinese(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "")) / F.length(text) > 0.2).otherwise(False)


def extract_between(text: Column, start: str, end: str) -> Column:
    """All spans between two literal tags, shortest first, across lines."""
    return F.regexp_extract_all(text, F.lit(f"(?s){java_quote(start)}(.*?){java_quote(end)}"), F.lit(1))


def java_quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def delimiter_regex(delimiters: str) -> str:
    """A pattern of the back-quoted multi-character delimiters and the single characters, longest first."""
    quoted = re.findall(r"`([^`]+)`", delimiters)
    single = set(re.sub(r"`[^`]*`", "", delimiters))
    return "|".join(java_quote(d) for d in sorted({*quoted, *single}, key=lambda d: (-len(d), d)))


def without_table_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def preview(content: Column, n: int = 100) -> Column:
    return F.concat(F.substring(F.replace(content, F.lit("\n"), F.lit(" ")), 1, n), F.lit("..."))


def query_lines(answer: Column) -> Column:
    """The lines of a numbered list without their numbers (the first keeps its own)."""
    return F.filter(F.transform(F.split(answer, r"\n\d*\.?\s*"), lambda x: collapse_ends(x)), lambda x: x != "")


def collapse_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cache_key(model: str, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(model), text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def row_sentence(table: str, columns: dict[str, Column]) -> Column:
    """A row as a sentence, missing cells filled with a marker."""
    cells = [F.concat(F.lit(f"{name}是“"), F.coalesce(c.cast("string"), F.lit(MISSING_CELL)), F.lit("”")) for name, c in columns.items()]
    return F.concat(F.lit(f"关于“{table}”中的一个表格数据记录: "), F.concat_ws(", ", *cells), F.lit("。"))


def not_bullet(line: Column) -> Column:
    return line.rlike(r"^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})")


def not_title(text: Column) -> Column:
    exempt = text.rlike("^第[零一二三四五六七八九十百0-9]+条")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return ~exempt & ((words > 12) | ((F.instr(text, " ") == 0) & (F.length(text) >= 32)) | text.rlike("[,;，。；！!]"))


def char_class(char: Column) -> Column:
    """``chinese``, ``digit`` or ``letter`` for one character of these, else null."""
    return F.when(char.rlike(r"^[\x{4e00}-\x{9fa5}]$"), "chinese").when(char.rlike("^[0-9]$"), "digit").when(char.rlike("^[a-zA-Z]$"), "letter")


def spaced_words(words: Column) -> Column:
    """Words in order, a space put between two of which the first ends and the second ends in Latin letters."""
    latin = lambda x: x.rlike("[a-zA-Z]$")
    return F.aggregate(words, F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.when((F.size(acc) > 0) & latin(F.try_element_at(acc, F.lit(-1))) & latin(x), F.array(F.lit(" "), x)).otherwise(F.array(x))))


def language_runs(text: Column) -> Column:
    """Runs of Chinese characters and runs of others between separators."""
    return F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fa5}]+|[^\x{4e00}-\x{9fa5} ,.<>/?;:'\[\]\\`!@#$%^&*()|{}+_=\-~]+"), F.lit(0))


def random_choices(values: Column, n: int, seed: int = 0) -> Column:
    """Values drawn with replacement, as many as n or the array's size."""
    k = F.least(F.lit(n), F.size(values))
    return F.when(k > 0, F.transform(F.slice(F.array(*(F.rand(seed + i) for i in range(n))), 1, k), lambda r: F.element_at(values, F.floor(r * F.size(values)).cast("int") + 1))).otherwise(F.slice(values, 1, 0))
