import random

import pytest

CLASHING = ["key", "node", "label", "row", "n", "h", "words", "score", "a", "b", "shard", "length", "y", "word", "c", "id", "rare", "seeds"]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows, with columns whose names operators use themselves."""
    def docs(rows, lang="en"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["x"] * len(CLASHING)) for i, t in rows], schema)

    return docs


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words; the same arguments give the same text."""
    def text(seed, n=120, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" if r.random() < 0.9 else f"Ünt{r.randrange(50)}," for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and blank texts, ties, repeated rows, one id on two texts, a very long text and a very long word."""
    long = " ".join(prose(s, 2000) for s in range(4))
    return [
        (1, prose(1)), (2, prose(2)), (2, prose(2)), (3, prose(1)), (4, None), (5, ""), (6, " \n\t "), (None, prose(3)), (None, None), (7, "one"),
        (8, "one"), (9, prose(9)), (9, prose(10)), (10, long), (11, "x" * 5000), (12, prose(1) + " tail"), (13, "\u2028 \x1c a\x00b \U0001f600"),
    ]
