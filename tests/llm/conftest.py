import random

import pytest

WORDS = {"en": "the of and to in is that it was for on are with as at be this have from or", "fr": "le la les des et en un une du pour que dans qui sur pas plus par avec tout faire", "de": "der die und das ist nicht ein eine mit sich auf für auch dem von werden haben wird sind nach"}


def sentence(rnd: random.Random, lang: str = "en", n: int = 60) -> str:
    return " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(["", "", "ly", "ing", "ed", "er"]) for _ in range(n))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, part int, score double, group_id string, label string, g int, n int, root int, key int, salt int, shard int, _id int, _uid int, stays int, count int"
EXTRA = ("x", 1, 0.5, "y", "z", 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeats, and columns with the operators' inner names."""
    rnd = random.Random(3)
    a, b = sentence(rnd), sentence(rnd, "fr")
    long = sentence(rnd, "de", 60_000)
    rows = [(1, a, "en", "s"), (2, b, "fr", "s"), (2, b, "fr", "s"), (3, a, "en", None), (None, a, None, "s"), (None, None, None, None), (4, None, "en", "s"), (5, "", "en", "s"), (6, "?!", "en", "s"), (7, "one two", "en", "s"), (8, "one two", "en", "t"), (9, long, "de", "s"), (10, long + " end", "de", "s"), (11, "x" * 300_000, "en", "s"), (2, sentence(rnd), "en", "s")]
    data = [(*r, None if r[1] is None else len(r[1]), *(EXTRA if k % 2 else (None,) * len(EXTRA))) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
