"""Fuzzy decontamination over texts, held against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill import queries
from corpusmill.functions import similarity
from corpusmill.operators import dedup

WORDS = "the of and to in is that it was for on are with as at be this have from or été".split()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(texts, items, threshold):
    score = lambda a, b: 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    return {i for i, t in texts if t is not None and any(score(t, x) >= threshold for x in items if x is not None)}


def corpus():
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [text(rnd.randint(15, 40)) for _ in range(12)]
    docs = [text(rnd.randint(5, 120)) for _ in range(20)]
    for k, t in enumerate(items):
        docs.append("".join(c for c in t if rnd.random() > 0.02 * k))  # letters lost
        docs.append(text(3 * k) + t)  # within a longer text
    return [*enumerate(docs), (100, None), (101, ""), (102, items[0]), (103, items[0])], [*items, None, items[1]]


def test_query_over_documents_and_benchmark(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = brute(docs, items, queries.FUZZY_TEXTS)
    got = [r["doc_id"] for r in entry.queries()["decontaminate_fuzzy"](spark, str(tmp_path)).collect()]
    assert 10 < len(gone) < 30 and sorted(got) == sorted({i for i, _ in docs} - gone)


@pytest.mark.parametrize("threshold", [0, 60, 85, 100, 101])
def test_sent_and_shuffled_sides_agree(spark, monkeypatch, threshold):
    docs, items = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, s string").withColumnRenamed("doc_id", dedup.ROW_ID)
    theirs = spark.createDataFrame([(x,) for x in [*items, ""]], "s string")
    run = lambda: sorted(r[0] for r in dedup.external_fuzzy_removed(rows, theirs, threshold).collect())
    sent = run()
    assert sent == sorted(brute(docs, [*items, ""], threshold))
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    assert run() == sent
    assert dedup.external_fuzzy_removed(rows, theirs.where(F.lit(False)), threshold).count() == 0


@pytest.mark.parametrize("cutoff", [100, 90, 75, 60, 33])
def test_matcher(cutoff):
    rnd = random.Random(cutoff)
    some = lambda: "".join(rnd.choice("abc\u00e9\U0001f600") for _ in range(rnd.randint(0, 12)))
    for _ in range(40):
        strings = [some() for _ in range(rnd.randint(1, 9))]
        matcher = similarity.Matcher(strings, cutoff, chars=30)
        for x in [some() for _ in range(10)]:
            assert matcher.hit(x) == bool(brute([(0, x)], strings, cutoff))


@pytest.mark.parametrize("cutoff", [95, 86, 80, 73, 66, 50, 0])
def test_matcher_of_long_texts(cutoff):
    """Texts that are long enough to be divided into classes of characters, with their exact ratios."""
    rnd = random.Random(cutoff)
    edited = lambda x, p: "".join(c if rnd.random() > p else rnd.choice(["", "\u00e9", "zz"]) for c in x)
    base = ["".join(rnd.choice("abcde\u00e9 fghij\U0001f600") for _ in range(rnd.randint(150, 400))) for _ in range(6)]
    strings = ["", *base, *(edited(x, p) for x in base for p in (0.02, 0.1, 0.25))]
    matcher = similarity.Matcher(strings, cutoff, chars=900)
    for x in [*base[:3], *strings[8::4], ""]:
        want = {k: 200.0 * lcs(s, x) / (len(s) + len(x)) if s or x else 100.0 for k, s in enumerate(strings)}
        assert dict(matcher.matches(x)) == pytest.approx({k: v for k, v in want.items() if v >= cutoff})


@pytest.mark.parametrize("threshold, exact", [(0, True), (80, True), (80, False), (100, False)])
def test_fuzzy_removed_whatever_the_blocks(spark, monkeypatch, threshold, exact):
    docs, items = corpus()
    docs = [*docs, *((200 + k, x) for k, x in enumerate(items))]
    texts = {i: t for i, t in docs if t is not None}
    score = {(i, j): 200.0 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for i, x in texts.items() for j, y in texts.items() if x != y}
    first = {t: min(i for i, u in texts.items() if u == t) for t in texts.values()}
    gone = set()
    for i, x in texts.items():
        near = [first[texts[j]] for j in texts if score.get((i, j), -1) >= threshold and texts[j] != x]
        if near and i > min(first[x], *near) or exact and i > first[x]:
            gone.add(i)
    rows = spark.createDataFrame(docs, "i long, s string").withColumnRenamed("i", dedup.ROW_ID)
    for chars in (1 << 19, 300):
        monkeypatch.setattr(dedup, "BLOCK_CHARS", chars)
        assert {r[0] for r in dedup.fuzzy_removed(rows, threshold, exact).collect()} == gone
    assert dedup.fuzzy_removed(rows.where("false"), threshold, exact).count() == 0
