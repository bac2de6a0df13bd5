"""Sinks: prepared Parquet, and an export folder with a dataset card and statistics."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import TokenizerSpec

PREPARED = "data/prepared"
_NAME = re.compile(r"^[A-Za-z0-9_-]+$")


def prepared_path(cfg: dict, split: str) -> str:
    tokenizer = str(cfg.get("tokenizer_config") or cfg.get("tokenizer_file") or cfg.get("base_model") or "none").replace("/", "_")
    return f"{(cfg.get('dataset_prepared_path') or PREPARED).rstrip('/')}/{split}_{tokenizer}_{cfg.get('sequence_len', 2048)}"


def save_prepared(cfg: dict, train: DataFrame, test: DataFrame | None = None) -> list[str]:
    out = []
    for split, df in (("train", train), ("eval", test)):
        if df is not None:
            df.write.mode("overwrite").parquet(prepared_path(cfg, split))
            out.append(prepared_path(cfg, split))
    return out


def validate_export(cfg: dict) -> tuple[str, str] | None:
    """(organisation, name) if an export is wanted; names of letters, digits, - and _ only."""
    up = cfg.get("hf_upload") or cfg.get("export") or {}
    if not up.get("enabled"):
        return None
    for k in ("organization", "dataset_name"):
        if not up.get(k):
            raise ValueError(f"an export needs {k}")
        if not _NAME.match(up[k]):
            raise ValueError(f"{k} may have letters, digits, - and _ only: {up[k]}")
    return up["organization"], up["dataset_name"]


def size_category(rows: int) -> str:
    for most, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M")):
        if rows < most:
            return name
    return "n>10M"


def dataset_card(name: str, cfg: dict, stats: dict) -> str:
    import yaml

    up = cfg.get("hf_upload") or cfg.get("export") or {}
    head = {"license": up.get("license", "other"), "tags": up.get("tags", []), "size_categories": [size_category(int(stats.get("rows", 0)))]}
    lines = [f"- {k}: {v}" for k, v in stats.items()]
    return f"---\n{yaml.safe_dump(head, sort_keys=False)}---\n\n# {name}\n\n{up.get('description', '')}\n\n## Configuration\n\n```yaml\n{yaml.safe_dump(dict(cfg), sort_keys=False)}```\n\n## Statistics\n\n" + "\n".join(lines) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def export(df: DataFrame, folder: str, cfg: dict, stats: dict | None = None) -> str:
    """What an upload would send: data, README.md and stats.json.  Nothing leaves the file system."""
    names = validate_export(cfg)
    if names is None:
        raise ValueError("the configuration asks for no export")
    path = f"{folder.rstrip('/')}/{names[0]}/{names[1]}"
    df.write.mode("overwrite").parquet(f"{path}/data")
    stats = {"rows": df.sparkSession.read.parquet(f"{path}/data").count()} | dict(stats or {})
    write_text(df.sparkSession, f"{path}/README.md", dataset_card(names[1], cfg, stats))
    write_text(df.sparkSession, f"{path}/stats.json", json.dumps(stats, indent=1))
    return path


def find_token(given: str | None = None) -> str:
    """A token for uploads: the one given, else that of the environment, else that of an earlier login."""
    if given or os.environ.get("HF_TOKEN"):
        return given or os.environ["HF_TOKEN"]
    saved = os.path.join(os.environ.get("HF_HOME") or os.path.expanduser("~/.cache/huggingface"), "token")
    if os.path.isfile(saved):
        with open(saved, encoding="utf-8") as f:
            return f.read().strip()
    raise ValueError("an upload needs a token: give one, set HF_TOKEN, or log in")


def upload(path: str, cfg: dict, token: str | None = None) -> str:
    """Sends an exported folder to the configuration's dataset; needs huggingface_hub and a folder that the driver can read."""
    names = validate_export(cfg)
    if names is None:
        raise ValueError("the configuration asks for no upload")
    key = find_token(token)
    try:
        from huggingface_hub import HfApi
    except ImportError as e:
        raise RuntimeError("uploads need huggingface_hub, which isn't installed") from e
    up, name = cfg.get("hf_upload") or cfg.get("export") or {}, "/".join(names)
    api = HfApi(token=key)
    api.create_repo(name, repo_type="dataset", private=bool(up.get("private", False)), exist_ok=True)
    api.upload_folder(folder_path=path.removeprefix("file://").removeprefix("file:"), repo_id=name, repo_type="dataset")
    return name


def debug_rows(df: DataFrame, n: int = 5, width: int = 200, tokenizer: TokenizerSpec | None = None, text_only: bool = False) -> list[dict]:
    """The first rows, for people to look at: their first 50 ids and what these are as text, or values cut to ``width`` characters.

    The native tokenizer's ids are hashes, and have no text.
    """
    if "input_ids" not in df.columns:
        return [r.asDict() for r in df.limit(n).select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns)).collect()]
    known = tokenizer.loaded() if tokenizer is not None and tokenizer.path else None
    out = []
    for r in df.limit(n).select("input_ids").collect():
        ids = list(r["input_ids"] or [])
        text = {"text": None if known is None else known.decode(ids) if text_only else known.decode(ids)[:width]}
        out.append(text if text_only else {"input_ids": ids[:50]} | text)
    return out
