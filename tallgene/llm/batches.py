"""Arrow batches cut into slices of bounded text, so that Python memory does not follow the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 2_000_000
#: Rows that Spark hands to a Python worker at once. The default of 10,000 rows of long texts is more than a small executor has beside its heap.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Hands memory that Python and Arrow have freed, but still hold, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, with :func:`give_back` behind each task: Spark keeps Python workers for later tasks, of other stages too,
    and an executor pays for what idle ones hold."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose rows' ``sizes`` add up to about ``limit``; a larger single row is a slice of its own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices by the bytes of a text column."""
    return slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), limit)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts with null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]
