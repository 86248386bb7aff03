"""Texts in many codecs, and bytes in none."""

import os

import pytest

from strataflow.sources import codecs, files

TEXTS = {
    "gb18030": "这是一个测试文件，我们用它来检查编码。中国的首都是北京，人口很多。",
    "big5": "這是一個測試文件，我們用它來檢查編碼。臺灣的天氣很好。",
    "euc_jp": "これは日本語のテストです。東京は大きな都市であり、人が多い。",
    "shift_jis": "これは日本語のテストです。東京は大きな都市であり、人が多い。",
    "euc_kr": "이것은 한국어 시험 문서입니다. 서울은 큰 도시이고 사람이 많습니다.",
    "cp1252": "Der Fluß läuft über die Brücke, où l’été est très agréable – señor Muñoz.",
    "cp1251": "Это проверка кодировки русского текста. Москва большой город.",
    "koi8_r": "Это проверка кодировки русского текста. Москва большой город.",
    "utf_8": "naïve 文 текст",
    "utf_16": "any text with a mark",
    "utf_16_le": "any text without a mark",
    "utf_16_be": "any text without a mark",
    "utf_8_sig": "a mark",
    "utf_32": "a mark",
}


@pytest.mark.parametrize("codec", TEXTS)
def test_codecs(codec):
    for text in (TEXTS[codec], "Header: value\n" + TEXTS[codec] + "\nplain end", TEXTS[codec] * 3000):
        found, confidence = codecs.detect(text.encode(codec))
        assert text.encode(codec).decode(found) == text and confidence > 0.5, (found, confidence)
        assert codecs.decode(text.encode(codec)) == text


def test_the_short_and_the_strange():
    assert codecs.detect(b"") == ("utf_8", 1.0) and codecs.decode(b"plain") == "plain"
    assert codecs.detect(os.urandom(5000))[1] < 0.7
    assert codecs.decode("这是测试".encode("gb18030")) == "这是测试" and codecs.decode("caf\xe9".encode("cp1252")) == "café"
    cut = ("文" * codecs.HEAD).encode()
    assert codecs.detect(cut) == ("utf_8", 0.99)


def test_folder(spark, tmp_path):
    for codec, text in TEXTS.items():
        (tmp_path / f"{codec}.txt").write_bytes(text.encode(codec))
    rows = {r["doc_id"]: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in rows.items()} == TEXTS and all(r["confidence"] > 0.5 for r in rows.values())
    assert rows["big5"]["codec"] == "big5"
