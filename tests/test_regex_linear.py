"""Searches that backtrack: by RE2, with Python's results, in a time that is linear in the text."""

import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import regex

PATTERNS = [
    (r"The.+\n.+licensed", re.S | re.I), (r"The.+\n.+licensed", re.I), (r"a.*b.*c", 0), (r"(?:ab|k)+\d", 0), (r"^\s*\w+\s*$", re.M), (r"[^\d\s]+_", 0), (r"(?i:s)+x", 0),
    (r"[i-k]+ .", re.I), (r"\d+[.,]\d{2}", 0), (r"\D+\S\W+é", 0), (r"\w+\b,", re.A), (r"\A.+?\Z", 0), (r"x* # none" + "\n y", re.X), (r"(a+)+b|é+c", 0), (r"[\]\^\\-]+-", 0),
]
PIECES = ["The", "the ", "licensed", "LICENſed", "lıcensed", "\n", "a", "b", "c", "k", "K", "é", "_", "1", "٣", "²", ".", ",", " ", " ", "\x1c", "x", "y", "]", "^", "\\", "-", "I", "J", "s"]


@pytest.mark.parametrize("pattern,flags", PATTERNS)
def test_the_same_texts_are_found(pattern, flags):
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(3000))]
    assert regex.backtracks(regex._parser.parse(pattern, flags))
    assert pc.match_substring_regex(pa.array(texts), regex.to_re2(pattern, flags)).to_pylist() == [re.search(pattern, t, flags) is not None for t in texts]


def test_what_has_no_equal_stays():
    for p in (r"(a)+\1", r"a+(?=b)", r"a+\bb", r"a+$", r"(?:a+){1001}b", r"[^\W\d]+_", r"é+b"):
        assert regex.to_re2(p, re.I if "é" in p else 0) is None
    for p in ("licensed under", "@[a-z]+", r"[0-9] x", r"^\d+", "(?:a|b)"):
        assert not regex.backtracks(regex._parser.parse(p))


def test_time_is_linear(spark):
    """20,000 places to begin, as many line ends, and no match."""
    df = spark.createDataFrame([("The \n" * 20_000,), (None,), ("The x\n licensed",)], "text string")
    began = time.time()
    assert [r[0] for r in df.select(regex.search(F.col("text"), r"The.+\n.+licensed", re.S | re.I)).collect()] == [False, None, True]
    assert time.time() - began < 30
