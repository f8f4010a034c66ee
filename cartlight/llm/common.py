"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows turned into Python objects at a time, so that a batch of long texts stays small.
SLICE = 256


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def append_columns(
    df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], fields: list[T.StructField]
) -> DataFrame:
    """Row-wise columns from Arrow batches; all columns of ``df`` stay.

    ``make`` maps batches to (batch, new arrays). A column of ``df`` that has
    the name of a new one (in any case) is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    names = [df.columns[i] for i in keep] + [f.name for f in fields]
    schema = T.StructType([df.schema.fields[i] for i in keep] + fields)

    def run(batches):
        for batch, arrays in make(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + arrays, names)

    return df.mapInArrow(run, schema)


def position(df: DataFrame, column: str) -> int:
    """Index of a column; the first one of that name."""
    lower = [c.lower() for c in df.columns]
    if column.lower() not in lower:
        raise ValueError(f"no column {column!r} in {df.columns}")
    return lower.index(column.lower())


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses: extra columns never clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
