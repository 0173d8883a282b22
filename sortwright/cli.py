"""Command line: sort a file, or generate one. Exit codes: 0 done, 1 usage, 2 failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.format import human_bytes
from .job import run_sort
from .model import GeneratorOptions, InvalidMode, LineMode, SortOptions, TempPolicy
from .sources.generate import generate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sortwright")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sort")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--temp-dir")
    s.add_argument("--chunk-size-mb", type=int, default=512)
    s.add_argument("--invalid-mode", choices=[m.value for m in InvalidMode], default="strict")
    s.add_argument("--invalid-log")
    s.add_argument("--metrics-path")
    s.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--keep-temp", action="store_true")
    s.add_argument("--delete-temp-on-failure", action="store_true")
    s.add_argument("--delete-input-after-split", action="store_true")
    s.add_argument("--block-reader", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--overwrite-output", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--max-text-bytes", type=int)
    s.add_argument("--output-folder", action="store_true", help="leave the ordered parts as they are, without copying them to one file")
    g = sub.add_parser("generate")
    g.add_argument("output")
    g.add_argument("size_mb", type=int)
    g.add_argument("distinct", type=int, nargs="?", default=10_000)
    g.add_argument("seed", type=int, nargs="?", default=12345)
    return top


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args:
        parser().print_help()
        return 0
    try:
        a = parser().parse_args(args)
    except SystemExit as stop:
        return 1 if stop.code else 0
    spark = SparkSession.builder.appName("sortwright").getOrCreate()
    try:
        if a.command == "generate":
            print(generate(spark, GeneratorOptions(a.output, a.size_mb, a.distinct, a.seed)), "rows")
            return 0
        policy = TempPolicy.KEEP_ALL if a.keep_temp else TempPolicy.DELETE_ALWAYS if a.delete_temp_on_failure else TempPolicy.DELETE_ON_SUCCESS
        options = SortOptions(a.input, a.output, a.temp_dir, InvalidMode(a.invalid_mode), a.invalid_log, a.metrics_path, LineMode.LF if a.block_reader else LineMode.UNIVERSAL, policy, a.overwrite_output, a.resume, a.delete_input_after_split, a.max_text_bytes, a.chunk_size_mb, not a.output_folder)
        metrics = run_sort(spark, options)
        print(f"{metrics['ValidLines']} records, {human_bytes(metrics['OutputBytesWritten'])} written")
        return 0
    except Exception as error:
        print(f"failed: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
