"""Python over Arrow batches, a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_ROWS, OUT_ROWS = 256, 20_000  # of an Arrow batch taken to Python at once, and given back at once
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


def slices(batches: Iterator[pa.RecordBatch], rows_for, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Output rows of all rows, in batches of OUT_ROWS."""
    out: list[tuple] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            for row in batch.slice(lo, SLICE_ROWS).to_pylist():
                for made in rows_for(row):
                    out.append(made)
                    if len(out) >= OUT_ROWS:
                        yield _batch(out, kinds)
                        out = []
    if out:
        yield _batch(out, kinds)


def in_slices(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """`rows_of()` gives, once per task, a function from a row to output rows. A few rows are
    Python objects at a time, whatever the size of an Arrow batch and of a row's output."""
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return df.mapInArrow(lambda batches: slices(batches, rows_of(), kinds), schema)
