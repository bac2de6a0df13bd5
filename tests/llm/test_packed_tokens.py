"""op4 and the pipeline's last stage pack tokens of the vocabulary."""

import corpus_pipeline
from corpusmill.llm import packing, queries, token_counts
from corpusmill.llm.common import table

DATA = "/root/testdata/sf0.001"
COUNT = token_counts.counter(token_counts.VOCABULARY)


def encoded(docs):
    return {r["doc_id"]: n for r in docs.collect() if (n := COUNT([r["text"] or ""])[0])}


def placed(packed):
    per, bins = {}, {}
    for r in packed.collect():
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["tokens"]
        bins[r["bin_id"], r["bin_length"]] = bins.get((r["bin_id"], r["bin_length"]), 0) + r["tokens"]
    assert all(length in packing.LENGTHS and used <= length for (_, length), used in bins.items())
    return per


def test_op4_and_pipeline_pack_encoded_tokens(spark):
    docs = table(spark, DATA, "documents")
    want = encoded(docs)
    assert placed(queries.op4_best_fit_packing(spark, DATA)) == want
    assert placed(dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, DATA)) == want


def test_parts_add_up(nasty, monkeypatch):
    whole = [COUNT([r["text"] or ""])[0] for r in nasty.select("text").collect()]
    monkeypatch.setattr(token_counts, "PART_CHARS", 1000)
    assert [r[0] for r in nasty.select(token_counts.bpe_tokens()).collect()] == whole
