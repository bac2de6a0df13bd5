"""A stream of a table that is a folder of files."""

from pyspark.sql import functions as F

from corpusmill.streaming import stream


def test_a_folder_whose_name_has_a_dot(spark, tmp_path):
    """Its files don't have its name, and none was read."""
    path = f"{tmp_path}/rows.parquet"
    rows = spark.range(100).withColumn("text", F.col("id").cast("string"))
    rows.repartition(3).write.parquet(path)
    for k, source in enumerate((path, f"{path}/*.parquet")):
        live = stream.read_stream(spark, "parquet", source, rows.schema)
        stream.write_stream(live, f"{tmp_path}/out-{k}", f"{tmp_path}/state-{k}").awaitTermination()
        assert {r.id for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out-{k}").collect()} == set(range(100))
