"""Run metrics, observed where the plan runs once: on the unsorted ingest write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import line_bytes, render


def ingest_metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("lines"),
        F.count_if("ok").alias("ValidLines"),
        F.count_if(~F.col("ok")).alias("InvalidLines"),
        F.coalesce(F.sum(line_bytes(F.col("line"))), F.lit(0)).alias("InputBytesRead"),
    ]


def summary(parsed: DataFrame) -> DataFrame:
    """Counts and bytes of parsed lines, one row."""
    return parsed.agg(
        F.count_if("ok").cast("long").alias("valid_lines"),
        F.count_if(~F.col("ok")).cast("long").alias("invalid_lines"),
        F.coalesce(F.sum(line_bytes(F.col("line"))), F.lit(0)).cast("long").alias("input_bytes"),
        F.coalesce(F.sum(F.when(F.col("ok"), line_bytes(render(F.col("number"), F.col("text"))))), F.lit(0)).cast("long").alias("output_bytes"),
    )
