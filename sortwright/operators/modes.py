"""The three ways to treat lines that are no records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import InvalidMode


def apply_mode(parsed: DataFrame, mode: InvalidMode, max_text_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Records of parsed lines, and in log mode the rejected lines.

    Strict mode raises inside number and text, which every use of a record reads, so
    it can't be pruned away; filters and counts that read neither column don't raise.
    """
    if max_text_bytes is not None:
        fits = F.octet_length("text") <= max_text_bytes
        parsed = parsed.withColumn("text", F.when(~F.col("ok") | fits, F.col("text")).otherwise(F.raise_error(F.lit("a text exceeds the limit of bytes"))))
    if mode is InvalidMode.STRICT:
        error = F.raise_error(F.concat(F.lit("invalid line: "), F.coalesce("line", F.lit(""))))
        good = [F.when(F.col("ok"), F.col(c)).otherwise(error).alias(c) for c in ("number", "text")]
        return parsed.select(*good), None
    records = parsed.where("ok").select("number", "text")
    return records, parsed.where(~F.col("ok")) if mode is InvalidMode.LOG else None
