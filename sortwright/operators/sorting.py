"""Global order of records: text by its UTF-8 bytes, then number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Rows of a partition have consecutive ids below this, by the definition of monotonically_increasing_id.
_SPAN = 1 << 33


def _tied(records: DataFrame) -> DataFrame:
    """Equal records get different ties, so that a record which fills many partitions splits."""
    return records.withColumn("__tie", F.monotonically_increasing_id())


def sort_records(records: DataFrame) -> DataFrame:
    """One range exchange and a spilling sort; ranges are cut by text, number and place, so hot records split."""
    return _tied(records).orderBy("text", "number", "__tie").drop("__tie")


def with_position(records: DataFrame) -> DataFrame:
    """Append ``pos``, each record's 1-based place in the order.

    A range exchange and a sort within partitions, numbered there and written once;
    then each partition's rows are counted, and the counts before it are its base. What
    reaches the driver is a row a partition. Equal records have consecutive places.
    """
    dealt = _tied(records).repartitionByRange("text", "number", "__tie").sortWithinPartitions("text", "number", "__tie")
    ordered = stage(dealt.drop("__tie").withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33).cast("int")
    counted = ordered.groupBy(part.alias("__part")).agg(F.max(F.col("__id") % _SPAN + 1).alias("n")).collect()
    base, bases = 0, []
    for row in sorted(counted):
        bases.append((row["__part"], base))
        base += row["n"]
    totals = records.sparkSession.createDataFrame(bases, "__part int, __base long")
    # A row a partition.
    placed = ordered.withColumn("__part", part).join(F.broadcast(totals), "__part")
    return placed.withColumn("pos", F.col("__id") % _SPAN + 1 + F.col("__base")).drop("__part", "__id", "__base")


def head(records: DataFrame, n: int = 5) -> DataFrame:
    """The first n records in order."""
    return records.orderBy("text", "number").limit(n)


def tail(records: DataFrame, n: int = 5) -> DataFrame:
    """The last n records, in order."""
    return sort_records(records.orderBy(F.desc("text"), F.desc("number")).limit(n))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Parts as one bag; duplicates stay."""
    return reduce(DataFrame.unionByName, parts)


def merge_sorted(parts: list[DataFrame]) -> DataFrame:
    """Parts as one ordered bag."""
    return sort_records(union_all(parts))
