"""The margin keeps held-out documents of known languages, and rejects foreign, random and most ambiguous text."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from corpusmill.llm import language_id

ITALIAN = "il la di che e non per una sono con del come anche questo quando tutto ancora essere stato fare dove nella suo loro molto senza tempo casa giorno vita mondo uomo donna parte cosa bene grande nuovo prima dopo sempre".split()


def test_margin():
    rnd = random.Random(1)
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"]).to_pylist()
    rnd.shuffle(rows)
    fitted, held_out = rows[:5000], rows[5000:7000]
    model = {}
    for k in sorted({r["lang"] for r in rows}):
        texts = [r["text"] for r in fitted if r["lang"] == k][: language_id.TEXTS_PER_LANGUAGE]
        model[k] = language_id.letters(pa.array(texts, pa.string()))[0][: language_id.DICTIONARY_BYTES].strip()
    tools = language_id.compressors(model)

    def accepted(texts):
        out = language_id.classify(pa.array(texts, pa.string()), tools, language_id.MIN_MARGIN)[2]
        return sum(out) / len(out)

    def letters():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))

    assert accepted([r["text"] for r in held_out]) > 0.95
    assert accepted([" ".join(rnd.choice(ITALIAN) for _ in range(rnd.randint(60, 250))) for _ in range(150)]) < 0.02
    assert accepted([" ".join(letters() for _ in range(200)) for _ in range(150)]) < 0.02
    by = {k: [r["text"] for r in held_out if r["lang"] == k and 400 < len(r["text"]) < 4000] for k in model}
    mixed = []
    for _ in range(150):
        a, b = (rnd.choice(by[k]) for k in rnd.sample(sorted(by), 2))
        n = min(len(a), len(b))
        mixed.append(f"{a[:n]} {b[:n]}")
    assert accepted(mixed) < 0.65  # a margin alone can't tell them all: the dictionaries differ in reach
