"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct shingle hashes of a text. The sketch of a
union is the k smallest hashes of the two sketches, so sketches of parts merge
into the sketch of the whole. Two sketches estimate resemblance, containment and
the number of distinct shingles; below k shingles these are exact.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema, slices

WORDS = 5
K = 256
HASH_BITS = 48
MEMO_ENTRIES = 200_000
#: Bytes of text that a range of ids is meant to hold, and ranges that a task is meant to get.
RANGE_BYTES = 1 << 27
TASK_RANGES = 4

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = h
        return h


_WORDS = _Words()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[str], width: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; fewer words: one of them all."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    n = max(1, len(w) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, len(w))):
        total = total * _STEP + w[j : j + n]
    return mix(total)


def sketch(text: str | None, k: int = K, width: int = WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes of a text, ascending."""
    h = shingle_hashes(text.lower().split() if text else [], width) >> np.uint64(64 - HASH_BITS)
    if len(h) > 8 * k:
        least = np.unique(h[h <= np.partition(h, 4 * k)[4 * k]])
        if len(least) >= k:
            return least[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches describe."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness. Two empty sketches are alike (1), one empty is not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**HASH_BITS / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too (empty a: 1)."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def pack_sketch(a: np.ndarray) -> str:
    """A sketch as text: its hashes in ascending order, six bytes each, in base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack_sketch(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def edited_text(text: str, following: str) -> str:
    """The text whose last half is replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(cuts: list, kind: str) -> Column:
    """The range of a key k: how many cuts are not above it, by binary search (a null key: 0)."""
    ends = np.array(cuts)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, k.to_numpy(), side="right").astype(np.int32))

    return F.when(F.col("k").isNull(), 0).otherwise(place(F.coalesce("k", F.lit(cuts[0]).cast(kind))))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt so that a task sees each row's successor by ascending id.

    Returns (part, guest, k, t), sorted within partitions: ranges of ids are kept
    together, each followed by a guest row, which is the first row of the next range
    (after the last range: of the first). Texts cross the network once. Rows with
    equal ids follow each other by text; null ids come first. Ranges and tasks follow
    the bytes of the texts, so neither grows with the table; rows of one id are one range.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    held = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // (RANGE_BYTES * TASK_RANGES))
    parts = TASK_RANGES * tasks
    # At most one id a range comes to the driver.
    shares = F.lit(np.arange(1, parts) / parts)
    cuts = src.agg(F.percentile_approx("k", shares, max(10_000, 4 * parts)).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    dealt = src.withColumn("part", _range_of(cuts, src.schema["k"].dataType.simpleString()) if cuts else F.lit(0))
    ends = dealt.groupBy("part").agg(F.min("k").alias("first"), F.max(F.col("k").isNull()).alias("null_first"))
    order = Window.orderBy("part")
    everything = Window.partitionBy(F.lit(0))
    ends = ends.select(
        F.col("part").alias("own"),
        F.when(F.col("null_first"), F.lit(None)).otherwise(F.col("first")).alias("first"),
        F.coalesce(F.lag("part").over(order), F.max("part").over(everything)).alias("to"),
    )
    guests = dealt.join(F.broadcast(ends), (dealt["part"] == ends["own"]) & dealt["k"].eqNullSafe(ends["first"]))
    both = dealt.select("part", F.lit(False).alias("guest"), "k", "t").unionByName(
        guests.select(F.col("to").alias("part"), F.lit(True).alias("guest"), "k", "t")
    )
    return both.repartition(tasks, "part").sortWithinPartitions("part", "guest", "k", "t")


def fingerprint_edits(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WORDS
) -> DataFrame:
    """Fingerprint every whole text and its edited text.

    The edited text replaces the last floor(n_chars / 2) code points by the first as
    many (or all) of the next text in ascending order of ids; the first follows the
    last. Returns ``id_col``, text, edited, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row. A null text counts as empty; an
    empty text has an empty fingerprint, which is like another empty one only.
    Repeated rows are each other's successors; other columns are ignored; an empty
    table gives an empty table. A task holds one text and its successor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        held, over = None, False
        for rows in slices(batches):
            schema = arrow_schema([("k", rows.schema.field(2).type), ("text", pa.string()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            out = []
            for part, guest, key, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                own = None if guest and over else sketch(text, k, width)
                if held is not None and not over:
                    prior, words, mine = held
                    edited = edited_text(words, text)
                    other = sketch(edited, k, width)
                    out.append((prior, words, edited, pack_sketch(mine), pack_sketch(other), resemblance(mine, other, k), resemblance(mine, own, k)))
                if guest:
                    held, over = None, True
                else:
                    held, over = (key, text, own), False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    out = with_next(df, id_col, text_col).mapInArrow(run, f"k {kind}, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", id_col)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WORDS) -> DataFrame:
    """Sketch every whole text: (``id_col``, sketch array<long> ascending). No shuffle.

    A null or empty text has an empty sketch; repeated rows and null ids are kept;
    other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for rows in slices(batches):
            schema = arrow_schema([("k", rows.schema.field(0).type), ("sketch", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([sketch(t, k, width).astype(np.int64) for t in rows.column(1).to_pylist()], pa.list_(pa.int64()))], schema=schema)

    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"k {kind}, sketch array<bigint>").withColumnRenamed("k", id_col)


def merge_sketches(df: DataFrame, by: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """Merge the sketches of each group: (``by``, sketch).

    Each task first keeps its own k smallest hashes a group, so a group that holds a
    third of all rows reaches its merging task as k hashes a task.
    """
    values = df.select(F.col(by).alias("g"), F.explode(sketch_col).alias("h")).distinct()
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("r") <= k)
    merged = first.groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    groups = df.select(F.col(by).alias("g")).distinct()
    out = groups.join(merged, groups["g"].eqNullSafe(merged["g"]), "left").select(groups["g"], F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch"))
    return out.withColumnRenamed("g", by)
