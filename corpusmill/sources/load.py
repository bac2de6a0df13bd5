"""Datasets as named in a configuration: files of a format, or a folder of splits and subsets."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import checked
from ..operators.base import ROW_ID
from ..functions.values import free_name
from ..operators.sampling import dense_rank

LOG = logging.getLogger(__name__)
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "text": "text", "txt": "text", "orc": "orc", "image": "binaryFile", "imagefolder": "binaryFile"}
_SPLIT = re.compile(r"^([\w-]+)(?:\[(\d+%?)?:(\d+%?)?\])?$")


def parse_split(split: str) -> tuple[str, str | None, str | None]:
    """``train[10:20]`` or ``train[:5%]`` as (name, from, to)."""
    m = _SPLIT.match(split or "train")
    if not m:
        raise ValueError(f"not a split: {split}")
    return m.groups()


def files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, on any file system Spark reads; a file or nothing holds nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))


def guess_format(spark: SparkSession, path: str) -> str:
    names = [path, *(n for n, _ in files(spark, path))]
    for n in names:
        kind = n.rsplit(".", 1)[-1].lower() if "." in n.rsplit("/", 1)[-1] else ""
        if kind in FORMATS:
            return FORMATS[kind]
        if kind in ("png", "jpg", "jpeg", "ppm"):
            return "binaryFile"
    return "parquet"


def read(spark: SparkSession, kind: str, paths: str | list[str], spec: dict) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if spec.get("schema"):
        reader = reader.schema(spec["schema"])
    if kind == "csv":
        return reader.csv(paths, header=True, inferSchema="schema" not in spec, sep=spec.get("delimiter", ","), multiLine=True, escape='"')
    if kind == "json":
        # .json may be one array, .jsonl is a record a line, which can be split
        return reader.json(paths, multiLine=bool(spec.get("multi_line", all(p.endswith(".json") for p in paths))))
    if kind == "text":
        return spark.read.text(paths).withColumnRenamed("value", "text")
    if kind == "binaryFile":
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        none = lambda t: F.lit(None).cast(t)
        image = F.struct(F.col("content").alias("bytes"), F.col("path"), none("int").alias("width"), none("int").alias("height"), none("string").alias("mode"))
        # sizes are read from the headers here, so that no later step has to ask the bytes for them
        found = raw.select(image.alias("image")).select("image", checked(F.col("image"), whole=False).alias("c"))
        return found.select(F.struct("image.bytes", "image.path", "c.width", "c.height", "c.mode").alias("image"))
    return reader.format(kind).load(paths)


def _folder(spark: SparkSession, spec: dict, subset: str | None, split: str) -> DataFrame:
    """path[/subset][/split], as far as these folders or files exist."""
    path = spec["path"].rstrip("/")
    if subset:
        names = {n.split(".")[0]: n for n, _ in files(spark, path)}
        if subset not in names:
            raise FileNotFoundError(f"{path} has no subset {subset}")
        path = f"{path}/{names[subset]}"
    names = {n.split(".")[0]: n for n, _ in files(spark, path)}
    if split in names:
        path = f"{path}/{names[split]}"
    kind = FORMATS.get(spec.get("format", ""), None) or guess_format(spark, path)
    df = read(spark, kind, path, spec)
    # one table of all splits
    return df.where(F.col("split") == split) if split != "train" and split not in names and "split" in df.columns else df


def subsets(spark: SparkSession, path: str) -> list[str]:
    return [n for n, folder in files(spark, path) if folder and not n.startswith(("_", "."))]


def load_dataset(spark: SparkSession, spec: dict) -> DataFrame:
    """One entry of ``datasets``.

    ``path`` is a folder, a file, or with ``data_files`` a format's name.  ``subset``
    is a name, a list, or ``_ALL``; subsets that can't be read are left out with a
    warning, and if none can, the path is read without one.  ``split`` may be sliced.
    """
    split, start, end = parse_split(spec.get("split", "train"))
    if spec.get("data_files"):
        given = spec["data_files"]
        if isinstance(given, dict):
            given = given.get(split, next(iter(given.values())))
        df = read(spark, FORMATS.get(spec["path"], spec["path"]), given, spec)
    else:
        subset = spec.get("subset")
        if subset == "_ALL":
            subset = subsets(spark, spec["path"])
        parts = []
        for s in [subset] if isinstance(subset, str) else subset or []:
            try:
                parts.append(_folder(spark, spec, s, split))
            except Exception as e:
                LOG.warning("subset %s is left out: %s", s, e)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else _folder(spark, spec, None, split)
    return slice_rows(df, start, end, spec.get("order_by")) if start or end else df


def slice_rows(df: DataFrame, start: str | None, end: str | None, order_by: str | None = None) -> DataFrame:
    """Rows [start, end) by order, as counts or per cents; a start of 0 is a plain limit."""
    n = df.count() if "%" in f"{start}{end}" else None
    at = lambda x: round(n * int(x[:-1]) / 100) if x.endswith("%") else int(x)
    lo, hi = at(start) if start else 0, at(end) if end else None
    if lo == 0 and hi is not None:
        return df.orderBy(order_by).limit(hi) if order_by else df.limit(hi)
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    had, rank = ROW_ID in df.columns, free_name(df, "rank")
    ranked = dense_rank(df if had else df.withColumn(ROW_ID, order), rank, F.col(ROW_ID))
    inside = (F.col(rank) >= lo) & (F.lit(True) if hi is None else F.col(rank) < hi)
    return ranked.where(inside).drop(rank, *([] if had else [ROW_ID]))


def concat_datasets(parts: list[DataFrame]) -> DataFrame:
    """All rows, by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
