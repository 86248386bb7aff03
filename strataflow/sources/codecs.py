"""Which codec a file's bytes are in: marks and patterns first, then how well the characters that each codec gives fit together.

A codec is only weighed if the head of the file is whole in it. Texts of several bytes a character are weighed by where their characters
stand in the codec's own table, which lists frequent ones first, texts of one byte a character by letters that belong to words.
"""

from __future__ import annotations

import codecs
import re

#: So much of a file is looked at.
HEAD = 1 << 16
# Byte order marks, and the codecs that are weighed, of which the first wins where weights are equal.
MARKS = ((b"\xef\xbb\xbf", "utf_8_sig"), (b"\xff\xfe\x00\x00", "utf_32"), (b"\x00\x00\xfe\xff", "utf_32"), (b"\xff\xfe", "utf_16"), (b"\xfe\xff", "utf_16"))
WIDE = ("gb18030", "big5", "euc_jp", "shift_jis", "euc_kr")
NARROW = ("cp1252", "cp1251", "koi8_r")
# Frequent characters of Chinese, simple and traditional.
FREQUENT = {"gb18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年", "big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年"}


def _head(data: bytes, codec: str) -> str | None:
    """The text of the head, whose last character may be cut."""
    decoder = codecs.getincrementaldecoder(codec)()
    try:
        return decoder.decode(data[:HEAD], final=len(data) <= HEAD)
    except UnicodeDecodeError:
        return None


def _zeros(data: bytes) -> str | None:
    """UTF-16 without a mark: the zeros of mostly Latin text are all at odd or all at even places."""
    even, odd = data[:HEAD:2].count(0), data[1:HEAD:2].count(0)
    n = len(data[:HEAD]) // 2
    if n and len(data) % 2 == 0 and max(even, odd) > 0.3 * n and min(even, odd) < 0.05 * n:
        return "utf_16_le" if odd > even else "utf_16_be"
    return None


def wide_weight(text: str, codec: str) -> float:
    """The share of characters beyond ASCII that a text of the codec's language would mostly have: its script, in the table's first part."""
    good, n = 0.0, 0
    kana = len(re.findall("[぀-ヿ]", text))
    for c in text:
        if c < "\x80":
            continue
        n += 1
        lead = c.encode(codec)[0]
        han = "一" <= c <= "鿿"
        if codec == "gb18030":
            good += han and 0xB0 <= lead <= 0xD7 or c in "，。、；：？！“”‘’（）《》　—…"
        elif codec == "big5":
            good += han and 0xA4 <= lead <= 0xC6 or c in "，。、；：？！「」『』（）《》　—…"
        elif codec == "euc_kr":
            good += "가" <= c <= "힣"
        else:
            first = 0xB0 <= lead <= 0xCF if codec == "euc_jp" else 0x88 <= lead <= 0x97
            good += "぀" <= c <= "ヿ" or c in "、。「」　ー・" or han and first and kana > 0
    if n and codec in FREQUENT:
        # In Chinese some eight of a hundred characters at least are frequent ones; by chance it would be one or two.
        good *= 0.62 + 0.38 * min(1.0, sum(text.count(c) for c in FREQUENT[codec]) / (0.08 * n))
    return good / n if n else 0.0


def narrow_weight(text: str) -> float:
    """The share of characters beyond ASCII that are letters in words of their own script, in usual case."""
    good, n = 0, 0
    for m in re.finditer(r"[^\x00-\x7f]", text):
        n += 1
        c, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if not c.isalpha():
            good += c in "«»“”‘’–—…°§€£·¿¡№" and not (before.isalpha() and after.isalpha())
            continue
        latin = c <= "ɏ"
        beside = [x for x in (before, after) if x.isalpha()]
        # Latin letters with accents stand beside plain ones, others beside their like.
        same = not beside and c.islower() or (any(x.isascii() for x in beside) if latin else bool(beside) and all(x > "ɏ" for x in beside))
        usual = not c.isupper() or not before.isalpha() or before.isupper()
        good += same and usual
    return good / n if n else 0.0


def detect(data: bytes) -> tuple[str, float]:
    """(codec, confidence between 0 and 1). Bytes that no codec explains are cp1252 with a confidence below one half."""
    for mark, codec in MARKS:
        if data.startswith(mark):
            return codec, 1.0
    if (codec := _zeros(data)) and _head(data, codec) is not None:
        return codec, 0.9
    if (text := _head(data, "utf_8")) is not None:
        return "utf_8", 1.0 if text.isascii() else 0.99
    best = ("latin_1", 0.1)
    for codecs_, weigh in ((WIDE, wide_weight), (NARROW, lambda text, _: narrow_weight(text))):
        for codec in codecs_:
            text = _head(data, codec)
            if text is not None and not re.search("[\x00-\x08\x0e-\x1a\x7f-\x9f]", text) and (weight := 0.98 * weigh(text, codec)) > best[1] + 0.01:
                best = (codec, weight)
    return best


def decode(data: bytes) -> str:
    """The text by the codec that fits best; what turns out not to fit it later on is replaced."""
    return data.decode(detect(data)[0], errors="replace")
