"""Functions over Arrow batches, for the text search and the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a function gets at once, and bytes of the Arrow batches that Spark sends. Texts may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def give_back() -> None:
    """Returns to the system what this process has freed and its allocators still hold. Workers stay between tasks and stages, so without this each keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc only
        trim(0)


def in_arrow(df: DataFrame, function, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow in batches of `rows` rows at most: longer ones reach the function in slices. Spark's own batches are limited to BATCH_BYTES, which is a setting of the session that stays.
    At a task's end the worker gives back the memory that it no longer uses."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))
        finally:
            give_back()

    return df.mapInArrow(run, schema)
