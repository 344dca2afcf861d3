"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch. A worker holds a batch several times over, as Arrow, as Python
#: objects and as results, and the JVM holds it once more outside its heap.
ARROW_BYTES = 16 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Slices (first, end) of a string column of about ``most`` bytes, each of one row at least."""
    first, size = 0, 0
    for i, value in enumerate(column):
        n = len(value.as_buffer()) if value.is_valid else 0
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(column):
        yield first, len(column)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of at most ``ARROW_BYTES``, whose memory goes back when a task ends.

    The size of batches is a setting of the session; it is lowered there, never raised.
    """
    conf = df.sparkSession.conf
    now = int(re.sub(r"\D", "", conf.get(_BYTES_SETTING, None) or "") or 0)
    if not 0 < now <= ARROW_BYTES:
        conf.set(_BYTES_SETTING, str(ARROW_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies the function that ``make()`` builds once for each task to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return map_arrow(df, run, schema)
