"""One ordered text file, published by a rename."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.records import render


def fs_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_staging(sorted_records: DataFrame, staging: str) -> None:
    lines = sorted_records.select(render(sorted_records["number"], sorted_records["text"]).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(staging)


def part_files(spark: SparkSession, staging: str) -> list:
    """Committed part files by their numeric partition."""
    fs, path = fs_of(spark, staging)
    if not fs.exists(fs_of(spark, f"{staging}/_SUCCESS")[1]):
        raise RuntimeError("the staged output was not committed")
    parts = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
    return sorted(parts, key=lambda p: int(re.match(r"part-(\d+)", p.getName())[1]))


def publish(spark: SparkSession, staging: str, output: str, overwrite: bool = True) -> int:
    """Concatenate staged parts into ``output``.tmp and rename it; returns its bytes.

    The bytes stream through the driver once, as a single file requires. The old
    output stays in place until the new one is complete.
    """
    fs, target = fs_of(spark, output)
    tmp = fs_of(spark, f"{output}.tmp")[1]
    if fs.exists(target) and not overwrite:
        raise FileExistsError(output)
    fs.delete(tmp, False)
    jvm = spark.sparkContext._jvm
    try:
        out = fs.create(tmp, True)
        try:
            for part in part_files(spark, staging):
                parts_fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
                source = parts_fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
        size = fs.getFileStatus(tmp).getLen()
        replace(spark, f"{output}.tmp", output)
    except BaseException:
        fs.delete(tmp, False)
        raise
    return size


def publish_folder(spark: SparkSession, staging: str, output: str, overwrite: bool = True) -> int:
    """Rename the staged folder to ``output``, whose part files are in order; returns its bytes. No byte is copied."""
    fs, target = fs_of(spark, output)
    if fs.exists(target):
        if not overwrite:
            raise FileExistsError(output)
        fs.delete(target, True)
    size = sum(fs.getFileStatus(p).getLen() for p in part_files(spark, staging))
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(fs_of(spark, staging)[1], target):
        raise OSError(f"can't rename to {output}")
    return size


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another one, in one step: readers see the old file or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = overwrite
    fs, path = fs_of(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fs_of(spark, source)[1]), fs.makeQualified(path), options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole."""
    fs, target = fs_of(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
