"""Lines to records and back, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import UINT64_MAX

#: The white space that is trimmed around the number and before the text.
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
#: number, first dot, text; everything after the dot but leading white space is text.
RECORD_PATTERN = rf"(?s)\A{WHITE}([0-9]+){WHITE}\.{WHITE}(.*)\z"


def number_of(line: Column) -> Column:
    """The unsigned 64-bit number of a line, null if the line is no record."""
    digits = F.regexp_extract(line, RECORD_PATTERN, 1)
    value = F.nullif(digits, F.lit("")).try_cast("decimal(20,0)")
    return F.when(value <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)"), value)


def text_of(line: Column) -> Column:
    return F.regexp_extract(line, RECORD_PATTERN, 2)


def parse(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Append number, text and ok to lines; a line that is no record has a null number."""
    line = F.col(line_col)
    parsed = lines.withColumn("number", number_of(line))
    return parsed.withColumn("text", F.when(F.col("number").isNotNull(), text_of(line))).withColumn("ok", F.col("number").isNotNull())


def render(number: Column, text: Column) -> Column:
    """The canonical line of a record."""
    return F.concat(number.cast("string"), F.lit(". "), text)


def encoded_size(text: Column) -> Column:
    """Bytes of a record in a binary run."""
    return (F.octet_length(text) + 10).cast("long")


def memory_estimate(text: Column) -> Column:
    """Bytes that a record is reckoned to take in memory: a diagnostic only."""
    return (F.octet_length(text) + 96).cast("long")


def line_bytes(line: Column) -> Column:
    return (F.octet_length(line) + 1).cast("long")
