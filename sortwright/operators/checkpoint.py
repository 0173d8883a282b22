"""Committed ingest checkpoints: Parquet with a success marker and a fingerprint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..model import SortOptions
from .publish import fs_of, replace, write_text


def shape(options: SortOptions) -> list:
    """What shapes the records of an ingest, besides the input's files."""
    return [options.invalid_mode.value, options.line_mode.value, options.max_text_bytes]


def fingerprint(spark: SparkSession, options: SortOptions) -> str:
    """A digest of the input's files (path, size, time) and of what shapes records."""
    fs, path = fs_of(spark, options.input_path)
    found = fs.globStatus(path) or []
    files = []
    for entry in found:
        walk = fs.listFiles(entry.getPath(), True)
        while walk.hasNext():
            f = walk.next()
            files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    if not files:
        raise FileNotFoundError(options.input_path)
    return hashlib.sha256(json.dumps([sorted(files), *shape(options)]).encode()).hexdigest()


def _manifest(spark: SparkSession, root: str) -> dict | None:
    fs, path = fs_of(spark, f"{root}/manifest.json")
    if not fs.exists(path):
        return None
    try:
        return json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{root}/manifest.json").collect()))
    except ValueError:
        return None


def save(spark: SparkSession, root: str, state: dict) -> None:
    """Write the manifest beside its place and rename it, so it is whole or absent."""
    write_text(spark, f"{root}/manifest.json.tmp", json.dumps(state, indent=2))
    replace(spark, f"{root}/manifest.json.tmp", f"{root}/manifest.json")


def load(spark: SparkSession, root: str, key: str | None) -> tuple[DataFrame, dict] | None:
    """A committed checkpoint with this fingerprint, and its manifest; ``key`` None takes any."""
    state = _manifest(spark, root)
    if not state or state.get("stage") != "ingested" or key is not None and state.get("fingerprint") != key:
        return None
    fs, marker = fs_of(spark, f"{root}/records/_SUCCESS")
    if not fs.exists(marker):
        return None
    records = spark.read.parquet(f"{root}/records")
    return (records, state) if records.count() == state["metrics"]["ValidLines"] else None
