"""One document to many chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import whole_number
from ..functions.text import DELIMITERS, delimiter_regex, not_bullet, not_title, token_count

# The families of heading patterns, each from the highest level down.
BULLETS = (
    (r"第[零一二三四五六七八九十百0-9]+(分?编|部分)", r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"第[零一二三四五六七八九十百0-9]+条", r"[\(（][零一二三四五六七八九十百]+[\)）]"),
    (r"第[0-9]+章", r"第[0-9]+节", r"[0-9]{0,2}[\. 、]", r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"),
    (r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"[零一二三四五六七八九十百]+[ 、]", r"[\(（][零一二三四五六七八九十百]+[\)）]", r"[\(（][0-9]{0,2}[\)）]"),
    (r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"Chapter (I+V?|VI*|XI|IX|X)", r"Section [0-9]+", r"Article [0-9]+"),
)


#: A task hands chunks on once they have so many characters, after the document that they end with.
BATCH_CHARS = 2 << 20


def greedy_merge(pieces: list[str], size: int = 256) -> list[str]:
    """Pieces put together; a chunk closes once its tokens (half its characters) exceed size, or while it is empty.

    The list's places are the chunks' sequence numbers from 1; blank chunks keep theirs.
    """
    out: list[list[str]] = []
    chars = n = 0
    for piece in pieces:
        if not out or not chars or n > size:
            out.append([])
            chars = n = 0
        out[-1].append(piece)
        chars, n = chars + len(piece), n + len(piece) // 2
    return ["".join(own) for own in out]


def chunk_documents(docs: DataFrame, size: int = 256, delimiters: str = DELIMITERS) -> DataFrame:
    """``doc_id, sequence, chunk_id_str, content``; blank chunks are left out, documents of null text have none."""
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    cut = re.compile(delimiter_regex(delimiters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sequence, content = [], [], []

            def made(batch=batch, at=at, sequence=sequence, content=content) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sequence, pa.int32()), pa.array(content, pa.string())], names=["doc_id", "sequence", "content"])
                for x in (at, sequence, content):
                    x.clear()
                return out

            held = 0
            for i, text in enumerate(batch.column(1)):
                for k, chunk in enumerate(greedy_merge(cut.split(text.as_py()), size), 1):
                    at.append(i)
                    sequence.append(k)
                    content.append(chunk)
                    held += len(chunk)
                if len(at) > 10_000 or held > BATCH_CHARS:
                    yield made()
                    held = 0
            yield made()

    chunks = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sequence int, content string").where(F.col("content").rlike(r"\S"))
    return chunks.select("doc_id", "sequence", F.concat(F.col("doc_id").cast("string"), F.lit("_text_"), F.col("sequence").cast("string")).alias("chunk_id_str"), "content")


def _strip(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def bullet_family(sections: Column) -> Column:
    """The family that most sections match; the first of equals; -1 if none does."""

    def count(patterns: tuple[str, ...]) -> Column:
        return F.size(F.filter(sections, lambda s: _strip(s).rlike("^(?:" + "|".join(patterns) + ")") & ~not_bullet(_strip(s))))

    hits = [count(patterns) for patterns in BULLETS]
    most = F.greatest(*hits)
    out = F.lit(-1)
    for i in reversed(range(len(hits))):
        out = F.when((hits[i] == most) & (most > 0), i).otherwise(out)
    return out


def heading_level(line: Column, layout: Column, family: int) -> Column:
    """The first pattern of the family that the line matches; one more than the last for titles by layout; else two more."""
    size = len(BULLETS[family])
    level = F.when(layout.rlike("(title|head)") & ~not_title(F.split(line, "@")[0]), size).otherwise(size + 1)
    for i in reversed(range(size)):
        level = F.when(_strip(line).rlike("^(?:" + BULLETS[family][i] + ")") & ~not_bullet(line), i).otherwise(level)
    return level


def batches(rows: DataFrame, key: list[str], order: str, text: str, size: int = 10, separator: str = "; ") -> DataFrame:
    """Rows of a key in batches of size, joined in order."""
    batch = F.floor(F.col(order) / size).cast("long").alias("batch")
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*key, batch).agg(F.array_join(F.transform(lines, lambda x: x[text]), separator).alias("content"), F.count("*").alias("n_rows"))


# The patterns of numbered questions.
QUESTIONS = (
    r"第([零一二三四五六七八九十百0-9]+)问",
    r"第([零一二三四五六七八九十百0-9]+)条",
    r"[\(（]([零一二三四五六七八九十百]+)[\)）]",
    r"第([0-9]+)问",
    r"第([0-9]+)条",
    r"([0-9]{1,2})[\. 、]",
    r"([零一二三四五六七八九十百]+)[ 、]",
    r"[\(（]([0-9]{1,2})[\)）]",
    r"QUESTION (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
    r"QUESTION (I+V?|VI*|XI|IX|X)",
    r"QUESTION ([0-9]+)",
)


def question_pattern(sections: Column) -> Column:
    """The place of the first question pattern that any section matches; -1 if none does."""

    def hit(pattern: str) -> Column:
        return F.exists(sections, lambda s: s.rlike(f"^(?:{pattern})") & ~not_bullet(s))

    hits = [hit(p) for p in QUESTIONS]
    out = F.lit(-1)
    for i in reversed(range(len(hits))):
        out = F.when(hits[i], i).otherwise(out)
    return out


def frequent_level(levels: DataFrame, key: list[str], order: str, n_patterns: int) -> DataFrame:
    """key, ``level``: the most frequent level of headings, of equals the one seen first; n_patterns + 1 where all is plain text."""
    counted = levels.groupBy(*key, "level").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    heading = F.when(F.col("level") <= n_patterns, F.struct(-F.col("n"), "first"))
    return counted.groupBy(*key).agg(F.coalesce(F.min_by("level", heading), F.lit(n_patterns + 1)).alias("level"))


def paragraph_level(style: Column, text: Column, family: int) -> Column:
    """The level of a word processor's paragraph: its heading style's number, else by the family's patterns (from 1)."""
    line = _strip(F.translate(text, "　", " "))
    level = F.lit(0 if family < 0 else len(BULLETS[family]))
    for i in reversed(range(len(BULLETS[family]) if family >= 0 else 0)):
        level = F.when(line.rlike("^(?:" + BULLETS[family][i] + ")"), i + 1).otherwise(level)
    return F.when(style.startswith("Heading"), F.try_to_number(F.element_at(F.split(style, " "), -1), F.lit("99")).cast("int")).otherwise(level)


def greedy_merge_parts(parts: Column, size: int = 256, delimiters: str = DELIMITERS) -> Column:
    """Chunks ``text, images`` of parts ``text, image, position``, merged as texts are.

    A chunk keeps references to the images of its pieces in order. A piece of 8 tokens or more adds its position where its chunk
    doesn't have it. Nulls: no text, no image, no position.
    """
    pattern = delimiter_regex(delimiters)
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.coalesce(p["text"], F.lit("")), pattern), lambda t: F.struct(t.alias("text"), p["image"].alias("image"), F.coalesce(p["position"], F.lit("")).alias("position")))))
    chunk = "struct<text: string, images: array<string>>"
    none = F.lit(None).cast(chunk)
    empty = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), none.alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        close = acc["open"].isNull() | (acc["open"]["text"] == "") | (acc["n"] > size)
        n, before = token_count(piece["text"]), F.when(close, piece["text"]).otherwise(acc["open"]["text"])
        position = F.when((n >= 8) & (F.instr(before, piece["position"]) == 0), piece["position"]).otherwise("")
        image = F.filter(F.array(piece["image"]), lambda x: x.isNotNull())
        images = F.when(close, image).otherwise(F.concat(acc["open"]["images"], image))
        text = F.concat(F.when(close, F.lit("")).otherwise(acc["open"]["text"]), piece["text"], position)
        return F.struct(
            F.when(close & acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.struct(text.alias("text"), images.alias("images")).cast(chunk).alias("open"),
            F.when(close, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def positions(boxes: Column) -> Column:
    """Boxes ``page, left, right, top, bottom`` as whole numbers, pages from 1."""
    return F.transform(boxes, lambda b: F.struct((b["page"] + 1).cast("int").alias("page"), *(b[c].cast("int").alias(c) for c in ("left", "right", "top", "bottom"))))


# Headings of tables of contents, held against lines without their spaces.
CONTENTS = r"(contents|目录|目次|table of contents|致谢|acknowledge)$"


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _by_document(rows: DataFrame, columns: tuple[str, ...], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """Rows that f makes of the columns' lists, in order of ``at``, of each document, whose lines are together in a task."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", *columns))).alias("own"))
    names = ["doc_id", *(c.strip().split()[0] for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                made = f([r["at"] for r in own], *([r[c] for r in own] for c in columns))
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id.as_py(), **dict(zip(names[1:], r, strict=True))} for r in made], schema=out)

    out = pa.schema([pa.field(n, ARROW[t]) for n, t in zip(names, [kind, *(c.strip().split()[1] for c in schema.split(","))], strict=True)])
    return lists.mapInArrow(run, f"doc_id {kind}, {schema}")


def lines_without_contents(lines: list[str], english: bool = False, reach: int = 128) -> list[int]:
    """The places of the lines that aren't part of a table of contents.

    One begins at a heading; its first entry is the next line that isn't blank, and it ends where a line begins as that entry does (three
    characters, or two words of English), at most reach lines on. If none does, the heading and its first entry go alone.
    """
    def beginning(line: str) -> str:
        return " ".join(line.split()[:2]) if english else line.strip()[:3]

    out, at = [], 0
    while at < len(lines):
        if not re.match(CONTENTS, re.sub("[ \u3000]+", "", lines[at].strip().split("@@")[0])):
            out.append(at)
            at += 1
            continue
        at += 1
        while at < len(lines) and not beginning(lines[at]):
            at += 1
        if at < len(lines):
            entry = beginning(lines[at])
            at += 1
            at = next((j for j in range(at, min(at + reach, len(lines))) if lines[j].strip().startswith(entry)), at)
    return out


def without_contents(sections: DataFrame, english: bool = False, reach: int = 128) -> DataFrame:
    """``doc_id, at, text`` without tables of contents, of which a document may have several. A null text counts as blank."""

    def kept_of(at: list[int], text: list[str | None]) -> list[tuple]:
        return [(at[i], text[i]) for i in lines_without_contents([t or "" for t in text], english, reach)]

    return _by_document(sections, ("text",), f"at {sections.schema['at'].dataType.simpleString()}, text string", kept_of)


def chains(levels: list[int], n_levels: int, depth: int) -> list[list[int]]:
    """For the sections of the depth innermost levels, from the innermost on: the section and the headings above it, from the outermost.

    A heading further out that comes after one further in takes its place. Sections that a chain holds begin none of their own.
    """
    places: list[list[int]] = [[i for i, x in enumerate(levels) if x == level] for level in range(n_levels)]
    out, used = [], set()
    for level in range(n_levels - 1, max(-1, n_levels - 1 - depth), -1):
        for at in places[level]:
            if at in used:
                continue
            chain = [at]
            # Sections of the outermost level but one have no headings above them.
            for above in range(level - 1, -1, -1) if level != 1 else ():
                k = bisect_left(places[above], at)
                if k and len(chain) > 1 and places[above][k - 1] > chain[-1]:
                    chain.pop()
                if k:
                    chain.append(places[above][k - 1])
            used.update(chain)
            out.append(chain[::-1])
    return out


def hierarchical_merge(levels: DataFrame, n_patterns: int = 4, depth: int = 5, size: int = 218) -> DataFrame:
    """``doc_id, sequence, content``: sections below the headings above them, a line each; single ones are packed while under size tokens.

    levels: ``doc_id, at, level, text``, levels from 0 (outermost); n_patterns of them are of patterns, one of titles by layout, one of plain
    text. Sections of one character or of digits only are left out (what follows an ``@`` doesn't count).
    """

    def packs(_: list[int], level: list[int], text: list[str | None]) -> list[tuple]:
        said = [(t or "").split("@")[0].strip() for t in text]
        use = [i for i, s in enumerate(said) if len(s) > 1 and not re.fullmatch("[0-9]+", s)]
        out: list[list[str]] = [[]]
        n = 0
        for chain in chains([level[i] for i in use], n_patterns + 2, depth):
            own = [text[use[i]] for i in chain]
            tokens = len(re.sub("@@[0-9]+.*", "", own[0])) // 2 if len(own) == 1 else size
            if len(own) == 1 and tokens + n < size:
                out[-1] += own
                n += tokens
            else:
                out.append(own)
                n = tokens
        return [(k, "\n".join(o)) for k, o in enumerate((o for o in out if o), 1)]

    return _by_document(levels, ("level", "text"), "sequence int, content string", packs)


def colon_title(text: Column, least: int = 32) -> Column:
    """The last clause of a text that ends with a colon, if at least ``least`` characters come before it; else null.

    What is written after an ``@`` doesn't count. The clause is a title then.
    """
    said = _strip(F.split(text, "@")[0])
    before = F.regexp_extract(said, r"(?s)^(.*(?:[。？！!?;；]|\. ))[^。？！!?;；]*[:：]$", 1)
    return F.when(F.length(before) > least, F.substring(said, F.length(before) + 1, F.length(said)))


def question_bullets(boxes: DataFrame, pattern: int) -> DataFrame:
    """``doc_id, at, is_bullet, number`` of layout boxes ``doc_id, at, text, x0, top, layout``: which begin a numbered question.

    In order of ``at``: a box that matches the pattern counts unless it is indented by more than 10 against the bullet or the bullets before it,
    or stands on the line of a box that is none, or follows a colon; and if its number doesn't fall, or it asks (a question mark, a title, a
    question word first).
    """
    begin = re.compile(QUESTIONS[pattern])
    # Words that questions begin with.
    asks = re.compile("(what|when|where|how|why|which|who|whose|为什么|为啥|哪)")

    def detect(at: list[int], text: list[str], x0: list[float], top: list[float], layout: list[str]) -> list[tuple]:
        out, indents, last_number, last_bullet = [], [], 0, False
        for i, said in enumerate(text):
            hit, b, number, good = begin.match(said or ""), max(0, i - 1), None, False
            if hit:
                usual = sum(indents) / len(indents) if indents else x0[i]
                away = x0[i] - x0[b] > 10 if last_bullet else i > 0 and x0[i] >= x0[b] and top[i] - top[b] < 20
                if not (away or x0[i] - usual > 10 or (i and (text[b] or "").endswith((":", "：")))):
                    number = whole_number(hit.group(1))
                    rest = said[hit.end() :].lower()
                    good = not last_number or number >= last_number or said.endswith(("?", "？")) or layout[i] == "title" or bool(asks.match(rest))
            if good:
                indents.append(x0[i])
                last_number = number
            last_bullet = good
            out.append((at[i], good, number if good else None))
        return out

    return _by_document(boxes, ("text", "x0", "top", "layout"), "at int, is_bullet boolean, number int", detect)
