"""Helpers around ``mapInArrow``: the only door through which rows leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string; usable where no JVM is at hand only after being built on the driver."""
    return to_arrow_schema(_parse_datatype_string(ddl))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """Run ``make()`` once per task and its result once per Arrow batch.

    ``make`` is the place for per-task state (compiled models, caches).  A result of None emits nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def chunks_by_chars(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of consecutive texts that hold about ``most`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
