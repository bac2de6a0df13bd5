"""A corpus from raw documents: language, quality, near duplicates, benchmark leaks, packed sequences.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's ``docs``.  Labels and benchmark are read from sf_dir.

No stage sequence has an SQL form: compression, a fitted model and greedy packing are
out of SQL's reach.  Tests hold every stage's rows against plain Python.

Cases, as each operator's docstring says: a null or empty text, or one without
letters, goes at the first stage; null ids, languages and sources are carried; rows
that repeat an id and its text are copies, and one stays; ties go to the smallest id;
texts of any length are judged whole; other columns are kept as they are, whatever
their names; an empty table stays empty.  Without a known language all texts with
letters pass the first stage, with one they are held against none; without labels of
both classes the second keeps all; an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, jaccard_join, language_id, packing, quality, token_counts
from corpusmill.llm.common import Workspace, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told by a margin; null and empty texts go."""
    return language_id.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; it is fitted on the labelled rows that are left, and accepts all if one class is missing."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id (null first); rows in no group stay."""
    return jaccard_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontamination.drop_contaminated(docs, decontamination.build(table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; texts without a token have none."""
    return packing.pack_documents(docs, tokens=token_counts.bpe_tokens())


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; every stage's rows are a table in the shared folder."""
    ws, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
