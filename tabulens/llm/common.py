"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulens.plans.storage import materialize

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = rb"\x20\x09-\x0D"


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, columns: list[str], schema: str,
             work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over the named columns alone, so the scan reads nothing else."""
    return df.select(*columns).mapInArrow(work, schema)


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a row. Null ids have no fold."""
    return F.crc32(F.col(column).cast("string")) % parts


def tasks_for(df: DataFrame, per_core: int = 2) -> int:
    """Partitions for Python work on few large rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism * per_core, 1)


def stored(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder of the session and read back."""
    return materialize(df)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (or bytes) in ``column`` hold about ``limit`` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, before + limit, side="right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def small(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in ``slices``: what a task makes of one part is gone before the next, so that its memory does not
    follow the length of the texts of a whole batch."""
    for batch in batches:
        yield from slices(batch, column, limit)


@contextmanager
def batches_of(spark: SparkSession, limit: int = 4 << 20) -> Iterator[None]:
    """Jobs that run inside pass Arrow batches of about ``limit`` bytes at most to Python, not of 10,000 rows however wide:
    each task holds a batch in the JVM, outside the heap, and again in its worker. The session gets its own limit back."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, limit)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)
