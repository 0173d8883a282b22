"""Packing: concatenate all documents' tokens and cut at fixed windows.

Two passes. The first encodes each input partition and writes the ids with the
number of tokens before each document in its own partition. Partition totals (a
row a partition) then get prefix sums, which turn those local starts into global
offsets. The second pass is row-wise: each document falls into the windows its
range covers, and a document that crosses a window's end leaves a boundary
record there. Nothing is sorted or shuffled but the totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .arrow import arrow_schema, slices
from .bpe import coder
from .vocab import BYTE_BPE

WINDOW = 2048
END_ID = 1


def token_runs(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """First pass: (part, doc, local_start, n, ids) with ids as 16-bit integers where they fit."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(vocabulary)
        width = "<u2" if max(c.size, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for rows in slices(batches):
            schema = arrow_schema([("part", pa.int64()), ("doc", rows.schema.field(0).type), ("local_start", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
            ids = [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in c.encode_all(rows.column(1).to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // len(end)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), rows.column(0), pa.array(starts), pa.array(n), pa.array(np.full(len(n), len(end), np.int32)), pa.array(ids, pa.binary())], schema=schema)

    src = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"part long, doc {kind}, local_start long, n long, width int, ids binary")


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = BYTE_BPE,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack every document into sequences of ``window`` tokens.

    Each document is its ids and then ``end_id``; a null or empty text is the end
    id alone. Documents follow each other in scan order, so every sequence but the
    last is full. Returns one row per piece: ``id_col``, start (ids of the document
    before the piece), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (place in the sequence) and crosses (boundary
    record: the document goes on in the next sequence). Repeated rows and null ids
    are packed like any others; other columns are ignored; an empty table gives no
    pieces. A very long document becomes many pieces, each of bounded size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    runs = stage(token_runs(df, id_col, text_col, vocabulary, end_id), "runs")
    totals = runs.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per scan partition: the number of input splits bounds what is ordered and broadcast here.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = runs.join(F.broadcast(bases), "part").select("doc", (F.col("base") + F.col("local_start")).alias("at"), "n", "width", "ids")

    def cut(batches):
        for rows in slices(batches):
            schema = arrow_schema([("doc", rows.schema.field(0).type), *((x, pa.int64()) for x in ("start", "length")), ("ids", pa.binary()), *((x, pa.int64()) for x in ("doc_tokens", "sequence_id", "offset")), ("crosses", pa.bool_())])
            at, n = (np.asarray(rows.column(i), dtype=np.int64) for i in (1, 2))
            first, last = at // window, (at + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            seq = first[row] + k
            start = np.maximum(seq * window, at[row])
            end = np.minimum((seq + 1) * window, (at + n)[row])
            local, size = start - at[row], end - start
            whole = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(rows.column(4).to_pylist(), rows.column(3).to_pylist(), strict=True)]
            ids = [whole[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), local.tolist(), size.tolist(), strict=True)]
            for i in range(0, len(row), 4096):
                w = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[w])), pa.array(local[w]), pa.array(size[w]), pa.array(ids[w], pa.binary()), pa.array(n[row[w]]), pa.array(seq[w]), pa.array(start[w] - seq[w] * window), pa.array(seq[w] < last[row[w]])], schema=schema)

    out = placed.mapInArrow(cut, f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, crosses boolean")
    return out.withColumnRenamed("doc", id_col)
