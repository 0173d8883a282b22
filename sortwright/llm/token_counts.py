"""Token counts through a digest cache.

The cache is a table of (digest, n_tokens) for each tokenizer version, the version
being a digest of the tokenizer's file and options. Counting joins the digests of
the corpus to it, encodes each distinct content that is missing once, appends
those counts and then reads every document's count from the cache. Content is
normalised only as far as counts can't change: null becomes the empty text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ..staging import new_path, stage
from .arrow import arrow_schema, slices
from .vocab import PIECE_BPE

#: Changes when the way of counting does.
COUNTER = "piece-counter-1"
MEMO_ENTRIES = 600_000
MEMO_CHARS = 48
MARK = "▁"
#: Digests up to which a table of them is broadcast (about 50 bytes each); beyond it they are shuffled.
BROADCAST_DIGESTS = 1 << 20
#: Rows from which a digest's rows are counted without being dealt by it.
OFTEN = 256


class PieceCounter:
    """Counts the pieces of whole texts as sentencepiece does by default.

    If no piece holds the word mark after another character, the place before each
    mark that follows another character is a certain cut, so counts of words add up
    and are memoised. Otherwise, or with a normaliser that could look across words,
    whole texts are encoded.
    """

    def __init__(self, path: str = PIECE_BPE):
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        self.words = (
            norm.name == "identity"
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and proto.trainer_spec.model_type == 2
            and not any(p.type == 4 for p in proto.pieces)
            and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        )
        norm.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.lines = not any("\n" in p.piece for p in proto.pieces)
        self.memo = _Counts(self)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.words:
            return len(self.whole.encode(text))
        parts = text.replace(MARK, " ").split(" ")
        try:
            return sum(map(self.memo.__getitem__, parts))
        except KeyError:
            pass
        total, held = 0, MARK
        for i, part in enumerate(parts):
            if i:
                if held.endswith(MARK):
                    held += MARK
                else:
                    total, held = total + len(self.bare.encode(held)), MARK
            held += part
        return total + len(self.bare.encode(held))


class _Counts(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.bare, self.lines = counter.bare, counter.lines

    def __missing__(self, part: str) -> int:
        if not part:  # two marks side by side: no certain cut between them
            raise KeyError(part)
        n = len(self.bare.encode(MARK + part))
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[part] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def version_digest(path: str) -> str:
    """The tokenizer version: a digest of its file and of the way of counting."""
    with open(path, "rb") as f:
        return hashlib.sha256(COUNTER.encode() + f.read()).hexdigest()[:32]


class DigestCache:
    """Stored counts of one tokenizer version, an append-only Parquet table."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/version={version}"

    def read(self) -> DataFrame | None:
        """The stored counts (digest, n_tokens), or None before the first are."""
        schema = "digest binary, n_tokens long"
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(schema).parquet(self.path)

    def append(self, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self.path)


def _encode(misses: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches):
        c = counter(vocabulary)
        schema = arrow_schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
        for rows in slices(batches):
            n = np.fromiter(map(c.count, rows.column(1).to_pylist()), np.int64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.binary()), pa.array(n)], schema=schema)

    return misses.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = PIECE_BPE,
    cache_root: str | None = None,
) -> DataFrame:
    """Count the tokens of every whole text, encoding each distinct content once.

    Returns (``id_col``, n_bytes, n_tokens), one row per input row. A null text
    counts as empty: 0 bytes, 0 tokens. Equal texts share one stored count;
    repeated rows and null ids are kept; other columns are ignored; an empty table
    gives an empty table. ``cache_root`` names a cache that outlives the call;
    without it the call has a fresh one in the shared folder. Digests
    are joined to the cache first; only texts of misses are shuffled, pre-aggregated by
    digest, so a text that a third of all rows repeat crosses the network once per task.
    """
    spark = df.sparkSession
    cache = DigestCache(spark, cache_root or new_path(spark, "counts"), version_digest(vocabulary))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.col(id_col).alias("k"), text.alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    ids = stage(keyed.select("k", "digest", F.octet_length("t").cast("long").alias("n_bytes")), "digests")
    asked = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    stored = cache.read()
    misses = keyed
    if stored is not None:
        # Only digests are shuffled here; texts are, below, of misses alone.
        found = stage(asked.join(stored, "digest", "left_semi").select("digest"), "found")
        some = found.count()
        found = F.broadcast(found) if some <= BROADCAST_DIGESTS else found
        misses = keyed.join(found, "digest", "left_anti") if some else keyed
    misses = misses.groupBy("digest").agg(F.any_value("t").alias("t"))
    cache.append(_encode(misses.select("digest", "t"), vocabulary))
    counts = cache.read().join(asked, "digest", "left_semi") if stored is not None else cache.read()
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # A digest that many rows have would meet its rows in one task: those digests are few, and are broadcast.
    often = stage(asked.where(F.col("rows") >= OFTEN).join(counts, "digest").select("digest", "n_tokens"), "often")
    seldom, out = ids, []
    if 0 < often.count() <= BROADCAST_DIGESTS:
        out = [ids.join(F.broadcast(often), "digest")]
        seldom = ids.join(F.broadcast(often.select("digest")), "digest", "left_anti")
    out = reduce(DataFrame.unionByName, (x.select("k", "n_bytes", "n_tokens") for x in [*out, seldom.join(counts, "digest")]))
    return out.withColumnRenamed("k", id_col)
