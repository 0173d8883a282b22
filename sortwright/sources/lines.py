"""Text files as lines: every line once, whatever the input splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LineMode


def clean_line(value):
    """Drop one CR before the line's end and replace malformed UTF-8."""
    return F.make_valid_utf8(F.regexp_replace(value, r"\r\z", ""))


def read_lines(spark: SparkSession, path: str, mode: LineMode = LineMode.LF, with_place: bool = False) -> DataFrame:
    """Read text as a column ``line``; ``with_place`` adds file, block and row for input order."""
    reader = spark.read.option("lineSep", "\n") if mode is LineMode.LF else spark.read
    raw = reader.text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")] if with_place else []
    return raw.select(clean_line(F.col("value")).alias("line"), *place)


def numbered_lines(spark: SparkSession, path: str, mode: LineMode = LineMode.LF) -> DataFrame:
    """Lines with ``pos``, their 1-based number in file order, files following each other by name.

    Two passes: each split's rows are counted, and the counts of the splits before it
    are its base. What reaches the driver is a row a split.
    """
    lines = read_lines(spark, path, mode, with_place=True)
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    base, bases = 1, []
    for s in sorted(splits, key=lambda s: (s["file"], s["block"])):
        bases.append((s["file"], s["block"], base - s["first"]))
        base += s["n"]
    shifts = spark.createDataFrame(bases, "file string, block long, shift long")
    # A row a split.
    return lines.join(F.broadcast(shifts), ["file", "block"]).select((F.col("row") + F.col("shift")).alias("pos"), "line")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path and their bytes: (file, bytes). Contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
