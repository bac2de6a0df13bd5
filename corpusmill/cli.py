"""python -m corpusmill CONFIG [a.b=value ...]: prepares the datasets of a configuration."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.config import load_config
from .plans.prepare import prepare
from .sources.save import debug_rows, export, save_prepared, upload, validate_export


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    p.add_argument("config")
    p.add_argument("overrides", nargs="*", metavar="a.b=value")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--debug-text-only", action="store_true")
    p.add_argument("--debug-num-examples", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--export-to")
    p.add_argument("--upload", action="store_true", help="send what was exported")
    p.add_argument("--hf-token")
    p.add_argument("--prompter")  # taken, and without effect: strategies are named by datasets
    for name in ("--download", "--no-download", "--iterable"):
        p.add_argument(name, action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = load_config(args.config, args.overrides)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    done = prepare(spark, cfg, args.limit)
    for path in save_prepared(cfg, done.train, done.test):
        print(path)
        written = spark.read.parquet(path)
        if args.debug or args.debug_num_examples:
            rows = written.select([c for c, t in written.dtypes if t == "string"]) if args.debug_text_only and "input_ids" not in written.columns else written
            for row in debug_rows(rows, args.debug_num_examples or 5, tokenizer=done.context.tokenizer, text_only=args.debug_text_only):
                print(row)
        if args.export_to and validate_export(cfg) and "/train_" in path:
            folder = export(written, args.export_to, cfg, {k: v for k, v in done.context.stats().items() if v})
            print(folder)
            if args.upload:
                print(upload(folder, cfg, args.hf_token))
    return 0
