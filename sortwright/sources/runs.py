"""The binary run format, for exchange with other tools; sorting itself never uses it."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: header, version and record layout, little-endian.
MAGIC = b"LFSCHNK1"
VERSION = 2
_HEAD = struct.Struct("<8si")
_FIELDS = struct.Struct("<QH")
HEADER = _HEAD.pack(MAGIC, VERSION)
#: Records that are decoded at once.
BATCH = 1 << 16


def encode_record(number: int, text: str) -> bytes:
    raw = text.encode()
    if len(raw) > 0xFFFF:
        raise ValueError("a run holds texts of at most 65535 bytes")
    return _FIELDS.pack(number, len(raw)) + raw


def write_run(records: Iterable[tuple[int, str]]) -> bytes:
    return HEADER + b"".join(encode_record(n, t) for n, t in records)


def read_run(data: bytes) -> Iterator[tuple[int, str]]:
    if len(data) < _HEAD.size or _HEAD.unpack_from(data) != (MAGIC, VERSION):
        raise ValueError("not a run of this format and version")
    at = _HEAD.size
    while at < len(data):
        if at + _FIELDS.size > len(data):
            raise ValueError("the run is cut short")
        number, size = _FIELDS.unpack_from(data, at)
        at += _FIELDS.size
        if at + size > len(data):
            raise ValueError("the run is cut short")
        yield number, data[at : at + size].decode()
        at += size


def read_runs(spark: SparkSession, path: str, glob: str = "*.[bB][iI][nN]") -> DataFrame:
    """Read run files as records, a file a task; a task holds the file's bytes and a batch of records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                for rows in batched(read_run(data.as_py()), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array([str(n) for n, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["number", "text"])

    out = files.mapInArrow(run, "number string, text string")
    return out.withColumn("number", out["number"].cast("decimal(20,0)"))


def write_runs(records: DataFrame, path: str) -> int:
    """Write each partition as one ordered run file below ``path``, a folder that executors share; returns the files.

    A task streams into a file of its own attempt and renames it, so a task that is
    run again leaves one whole file. Empty partitions write none.
    """
    ordered = records.select(F.col("number").cast("string"), "text").sortWithinPartitions("text", F.col("number").cast("decimal(20,0)"))

    def run(batches):
        part, out = TaskContext.get().partitionId(), None
        where, root = arrow_fs.FileSystem.from_uri(path)
        name = f"{root.rstrip('/')}/run-{part:05d}.bin"
        tried = f"{name}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if batch.num_rows and out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(tried)
                out.write(HEADER)
            for number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(encode_record(int(number), text))
        if out is not None:
            out.close()
            where.move(tried, name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return len(ordered.mapInArrow(run, "file string").collect())
