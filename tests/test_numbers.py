"""Numbers in words: round trips and what is none."""

import random

from strataflow.functions import numbers


def test_round_trips():
    rng = random.Random(0)
    some = [*range(12_000), *(10**k + d for k in range(4, 13) for d in (-1, 0, 1, 10, 1005)), *(rng.randrange(10 ** rng.randint(1, 12)) for _ in range(4000)), 10**12]
    for n in some:
        english = " ".join(numbers.in_english(n))
        assert numbers.whole_number(english) == n, english
        assert numbers.whole_number(english.replace(" hundred ", " hundred and ").upper()) == n
        assert numbers.whole_number(numbers.in_chinese(n)) == n, numbers.in_chinese(n)
        assert numbers.whole_number(f" {n} ") == n
    for n in range(1, 4000):
        assert numbers.whole_number(numbers.in_roman(n)) == n


def test_forms():
    forms = {
        "twenty-one": 21, "one hundred and five": 105, "hundred": 100, "two thousand and one": 2001, "十": 10, "十二": 12, "一百一十": 110, "一百十": 110, "一百二十": 120, "两千零五": 2005, "廿三": 23, "卅": 30, "三万〇五": 30005,
        "一万零一十": 10010, "一亿零五百": 100000500, "一万亿": 10**12, "一千零一十万": 10_100_000, "壹佰贰拾叁": 123, "二〇二四": 2024, "〇": 0, "CXX": 120, "MCMXCIV": 1994, "-7": -7, "+12": 12, "9" * 30: -1,
    }
    assert {w: numbers.whole_number(w) for w in forms} == forms
    wrong = ["", "and", "one and", "and one", "twenty one hundred five six", "five twenty", "thousand million one", "two hundred hundred", "one two", "百", "一百五", "一百零五十", "五百千", "一零百", "万万万", "十十", "二十十", "IIII", "VX", "IC", "iv", "MMMM", "IVI", "x1", "1.5", "1_0", "１"]
    assert {w: numbers.whole_number(w) for w in wrong if numbers.whole_number(w) != -1} == {}


def test_column(spark):
    rows = spark.createDataFrame([("seven",), ("七",), ("VII",), (None,), ("xyz",)], "w string")
    assert [r["n"] for r in rows.select(numbers.number("w").alias("n")).collect()] == [7, 7, 7, -1, -1]
