"""Ranges of tokens by the size of the input."""

from corpusmill.operators import dedup, overlap
from corpusmill.operators.base import ROW_ID


def test_ranges_follow_the_input(spark, monkeypatch):
    """However few partitions are set, a range has some RANGE tokens."""
    monkeypatch.setattr(overlap, "RANGE", 100)
    made = []
    emit = overlap._emit
    monkeypatch.setattr(overlap, "_emit", lambda parts, *a: made.append(parts) or emit(parts, *a))
    df = spark.createDataFrame([(k, list(range(k, k + 50))) for k in range(100)], f"{ROW_ID} long, grams array<bigint>")
    assert dedup.containment_pairs(df, 90.0).count() == sum(100 - d for d in range(1, 6))
    assert made == [50]
