"""Arrow batches in and out of Spark, so that integers with nulls beside them stay integers.

pandas turns a column of 64-bit ids with one null into floats, which changes ids above 2^53. Ids here
are passed on as the Arrow columns they came in and never become Python or numpy numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def as_batch(columns: dict, schema: str) -> pa.RecordBatch:
    """A batch with the columns of a schema like "doc_id long, n int"; values are Arrow columns, numpy arrays or lists."""
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    made = []
    for name, kind in fields:
        value = columns[name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        made.append(value if isinstance(value, pa.Array) else pa.array(value, type=TYPES[kind]))
    return pa.RecordBatch.from_arrays(made, names=[n for n, _ in fields])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """df through run, which takes a task's batches and yields columns by name."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield as_batch(columns, schema)

    return df.mapInArrow(over, schema)


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
