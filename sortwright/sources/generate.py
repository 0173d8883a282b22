"""Deterministic record files: the rows depend on the seed, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import line_bytes, render
from ..model import GeneratorOptions

QUALITIES = "amber brisk calm dusty eager faint gentle hollow icy jolly keen lively mellow narrow opal plain quiet rusty silver tidy".split()
THINGS = "anchor bridge candle drum engine ferry garden harbor island jacket kettle lantern meadow needle orchard paddle quarry ribbon saddle tower".split()
ENDINGS = "at dawn|by the sea|for hire|in autumn|near home|of old|on a hill|over water|under glass|with care|without end".split("|")
TEXT_CHARS = 100
NUMBERS = 10**18


def _pick(words: list[str], key: Column, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def phrase(key: Column, seed: int) -> Column:
    """A text of two to seven words or endings, cut at 100 characters."""
    count = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(-1)), F.lit(6)) + 2
    parts = []
    for i in range(7):
        kind = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(100 + i)), F.lit(3))
        word = F.when(kind == 0, _pick(QUALITIES, key, seed + i)).when(kind == 1, _pick(THINGS, key, seed + i)).otherwise(_pick(ENDINGS, key, seed + i))
        parts.append(F.when(F.lit(i) < count, word))
    return F.left(F.concat_ws(" ", *parts), F.lit(TEXT_CHARS))


def records(spark: SparkSession, rows: int, distinct: int = 10_000, seed: int = 12345) -> DataFrame:
    """``rows`` records with numbers below 10^18 and texts from ``distinct`` phrases."""
    ids = spark.range(rows)
    number = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(NUMBERS)).cast("decimal(20,0)")
    pool = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(1, distinct)))
    return ids.select(number.alias("number"), phrase(pool, seed).alias("text"))


def generate(spark: SparkSession, options: GeneratorOptions) -> int:
    """Write lines of at least the wanted size in all; returns the number of rows."""
    if options.target_mb <= 0 or options.distinct_texts <= 0:
        raise ValueError("size and number of texts must be positive")
    trial = records(spark, 10_000, options.distinct_texts, options.seed)
    mean = trial.agg(F.avg(line_bytes(render(F.col("number"), F.col("text"))))).first()[0]
    rows = int(options.target_mb * (1 << 20) / mean * 1.01) + 1
    out = records(spark, rows, options.distinct_texts, options.seed)
    out.select(render(F.col("number"), F.col("text")).alias("value")).write.mode("overwrite").text(options.output_path)
    return rows
