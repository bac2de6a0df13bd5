"""Row-local processors on a stream, and exact-duplicate removal with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import free_name
from ..operators.base import Context
from ..operators.pipeline import create_processor
from ..storage import is_folder

#: These need the whole table: the order of rows, or all pairs.
WHOLE_TABLE = ("deduplicator", "random_sampler", "sample_packer")


def check_row_local(specs: list) -> None:
    for s in specs:
        if isinstance(s, dict):
            if s.get("type") in WHOLE_TABLE:
                raise ValueError(f"{s['type']} needs the whole table; it can't run on a stream")
            check_row_local((s.get("config") or s).get("processors") or [])


def apply_stream(df: DataFrame, specs: list, context: Context | None = None) -> DataFrame:
    check_row_local(specs)
    context = context or Context()
    for s in specs:
        df = create_processor(s, context)(df)
    return df


def read_stream(spark: SparkSession, kind: str, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Files of a folder, whatever its name, or those that match the last part of ``path``, as they arrive."""
    folder, _, last = path.rstrip("/").rpartition("/")
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    named = "*" in last or "." in last and not is_folder(spark, path)
    return reader.option("pathGlobFilter", last).load(folder) if named else reader.load(path)


def _instants(df: DataFrame, time: str) -> DataFrame:
    """A watermark needs instants: local times are read in the session's time zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")) if isinstance(df.schema[time].dataType, T.TimestampNTZType) else df


def drop_repeats(df: DataFrame, text: str = "text", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose text was seen within the watermark's delay go; state is a hash for each text, and expires."""
    mark = free_name(df, "key")
    return _instants(df, time).withColumn(mark, F.sha2(F.col(text), 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark([mark]).drop(mark)


def windowed_counts(df: DataFrame, time: str = "ts", key: str = "source", width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """What arrived, by window and key; late rows count until the watermark passes."""
    return _instants(df, time).withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
