"""Statistics over odd texts, held against the query's SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("odd", [["", ""], [None], ["", None, " ", "é" * 499, "é" * 500, "LICENSED under"]])
def test_empty_and_null_texts(spark, tmp_path, odd):
    texts = [*odd, "x" * 500, "x" * 499]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()["filter_stats"])
    (got,) = entry.queries()["filter_stats"](spark, str(tmp_path)).collect()
    assert dict(zip(want.columns, want.fetchall()[0])) == got.asDict()
