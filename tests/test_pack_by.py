"""Keys of pack_by that agree in a 32-bit hash stay apart."""

from pyspark.sql import functions as F

from corpusmill.operators.packing import exact_key
from corpusmill.operators.base import Context
from corpusmill.operators.pipeline import apply_all


def test_colliding_keys_are_packed_apart(spark):
    groups = spark.range(400_000).selectExpr("cast(id as string) id").groupBy(F.hash("id").alias("h")).agg(F.sort_array(F.collect_list("id")).alias("k")).where("size(k) > 1")
    a, b = groups.orderBy("h").first()["k"][:2]
    df = spark.createDataFrame([(0, a, "a a"), (1, b, "b b"), (2, a, "a"), (3, b, "b"), (4, None, "n"), (5, None, "n n")], "id long, key string, text string")
    spec = {"type": "sample_packer", "min_tokens": 1, "max_tokens": 20, "pack_by": "key", "separator": " "}
    out = apply_all(df, [spec], Context(order_by="id"))
    assert sorted(r["text"] for r in out.collect()) == ["a a a", "b b b", "n n n"]


def test_exact_key(spark):
    df = spark.sql("""select * from values ('1:a', 'b', array('a', null), x'00ff', timestamp '2020-01-01 00:00:00.000001'), ('1', 'a1:b', array('a'), x'00ff', timestamp '2020-01-01 00:00:00.000001'),
        (null, '-', array('a,b'), x'00', null), ('-', null, array('a', 'b'), x'00', null), ('', null, null, x'00fe', timestamp '2020-01-01 00:00:00.000002') as t(a, b, c, d, e)""")
    for names, distinct in ((["a", "b"], 5), (["c"], 5), (["d"], 3), (["e"], 3), (["c", "e"], 5)):
        assert len({r[0] for r in df.select(exact_key(df, names)).collect()}) == distinct
    assert {r[0] for r in df.select(exact_key(df, [])).collect()} == {""}
