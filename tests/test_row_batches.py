"""A function of rows holds a bounded number of them."""

import pandas as pd

from corpusmill.functions.batches import BATCH_ROWS
from corpusmill.operators.pipeline import RowFunction


def test_few_rows_at_a_time(spark):
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "10000")
    try:
        # each row says how many rows are held as dicts along with it
        seen: list = []

        def held(row: dict) -> dict:
            import gc

            if not seen:
                seen.append(max(len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame)))
            return {"id": row["id"], "held": seen[0]}

        df = spark.range(5000, numPartitions=1)
        got = RowFunction(held, "id long, held long")(df).collect()
        assert {r.id for r in got} == set(range(5000)) and max(r.held for r in got) <= BATCH_ROWS
    finally:
        conf.set(name, before)
