"""Arrow-batched row functions: the only bridge from DataFrames to Python used by the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array) and values.type == kind:
        return values
    made = pa.array(values, type=kind)
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """Apply fn to every Arrow batch; it returns columns (lists, numpy or Arrow arrays) by name, or None for no rows."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = fn(batch)
            if columns is None:
                continue
            arrays = [_as_array(columns[f.name], f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def apply_groups(df: DataFrame, keys: list[str], schema: T.StructType, fn: Callable[[pa.Table], dict | None]) -> DataFrame:
    """Apply fn to the whole Arrow table of each group; it returns columns by name, or None for no rows."""
    target = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        columns = fn(table)
        if columns is None:
            return target.empty_table()
        return pa.Table.from_arrays([_as_array(columns[f.name], f.type) for f in target], schema=target)

    return df.groupBy(*keys).applyInArrow(run, schema)
