"""Bounded-memory iteration for mapInArrow bodies."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows, and bytes of the rows' buffers, that a body handles at once.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def release() -> None:
    """Give memory that is free back to the system: a worker process outlives its tasks, one operator's after another."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that a body holds few rows, fewer when rows are long."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def rowwise(
    body: Callable[[pa.RecordBatch], dict], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one slice to a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(body(part), schema=schema)

    return run
