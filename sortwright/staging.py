"""Shared staging: written tables in the cluster's checkpoint folder.

A staged table cuts lineage: once written, a lost executor costs only a reread.
The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
local session without that setting gets a temporary folder of its own. Tables are
deleted at exit, or before by ``discard``, once what was read from them is staged.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []
#: Seconds between two full collections of garbage, at least.
COLLECT_S = 5.0
_COLLECTED = [0.0]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="sortwright-"))
    return _OWN[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that is used once and removed at exit."""
    path = f"{shared_root(spark)}/sortwright/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    # What the table was made from is garbage now; collecting it lets Spark delete its shuffle files.
    if time.monotonic() - _COLLECTED[0] > COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = (spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    held = getattr(df, "_staged", None)
    if held in _WRITTEN:
        _WRITTEN.remove(held)
        _delete(*held)


def remove_staged() -> None:
    """Delete every staged table of this process."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session is gone; nothing can be removed through it
            continue


atexit.register(remove_staged)
