import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing", ","]) + (rng.choice(["x", "q", "z"]) * rng.randrange(3)) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, prose(rng, 40)), (5, prose(rng, 40)), (6, "a b c"), (7, "same line\nSame Line \nother"), (7, "same line\nSame Line \nother"), (None, "no id here at all, really none"), (8, "é ß 中文 😀 <|endoftext|> ▁ x\x00y")]
    return spark.createDataFrame([(i, t, None, "x", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string").withColumnRenamed("TEXT_", "Hits")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
