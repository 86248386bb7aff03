import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, fp string, n_tokens string, text2 string, key string"


def make_texts() -> list[str | None]:
    """Nulls, blanks, copies, near copies, shared lines and passages, long runs, several languages."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ré", "éau", "straße", "ñandú", "and", "in", "on", "x", "alpha", "beta", "Gamma", "delta9", "42", "don't", "we'll", "ÉTÉ"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(150)]

    def prose(n: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", ".\n", "  ", "\t"]) for _ in range(n))

    base = [prose(rng.randint(3, 200)) for _ in range(20)]
    line, passage = "This is a Line that MANY documents share, with forty chars.", prose(40)
    texts: list[str | None] = [*base, *base[:4], base[0]]
    texts += [b.replace("the", "thé", 1) for b in base[4:8]]
    texts += [f"{prose(5)}\n  {line}\t\n{prose(5)}\n{line.upper()}" for _ in range(6)]
    texts += [prose(10) + passage + prose(10) for _ in range(4)]
    texts += [None, "", " ", "\n", "\n\n\n", "a", "one two", "<|endoftext|>", "x<|endoftext|> y  <|endoftext|>", "a" * 3000, " " * 700, "ab" * 400 + "\n" + "ab" * 400, "日本語 " * 50, "\x00\x1f null", prose(3000), "é" * 99, "stupid moron", "😀" * 60]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else "s", 1, -i, "f", "n", "t", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and repeated rows."""
    rows = [(None, "one two three four", None, None, None, None, None, None, None, None)] * 2 + [(3, "one two three four", None, None, None, 1, "", "", "", "")] * 2 + [(None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
