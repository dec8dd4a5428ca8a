"""Batches of rows for Python: integers stay integers beside nulls, and a batch holds few texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch: texts are long, so few rows make a batch.
BATCH_ROWS = 512
#: Integers and truth values that keep their nulls in pandas; by default a null turns a column of ids into floats.
NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: an Arrow batch holds at most BATCH_ROWS rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def plain_rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a frame as tuples of plain values, None for each null."""
    columns = [frame.iloc[:, i] for i in range(frame.shape[1])]
    return zip(*[c.astype(object).where(c.notna(), None) for c in columns])


def give_back() -> None:
    """Return memory that a task no longer uses to the system, as a worker lives on and shares its machine with others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Plain values as a column; maps are laid out end to end, which is much faster than one by one."""
    if pa.types.is_map(kind) and None not in values:
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        keys, items = [k for d in values for k in d], [v for d in values for v in d.values()]
        return pa.MapArray.from_arrays(pa.array(ends), pa.array(keys, kind.key_type), pa.array(items, kind.item_type), type=kind)
    return pa.array(values, type=kind, from_pandas=True)


def _batches(out: pd.DataFrame | list[tuple], made: pa.Schema) -> Iterator[pa.RecordBatch]:
    if not len(out):
        return
    if isinstance(out, list):
        yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*out), made)], schema=made)
    else:
        yield from pa.Table.from_pandas(out, schema=made, preserve_index=False).combine_chunks().to_batches()


def _plain(column: pa.Array) -> list:
    """The values of a column, None for each null."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def map_values(rows: DataFrame, run: Callable[[Iterator[list[list]]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """``map_frames`` for rows that are taken one by one: ``run`` gets the columns of each batch as lists of plain values."""
    small_batches(rows.sparkSession)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run([_plain(c) for c in b.columns] for b in batches):
            yield from _batches(out, made)
        give_back()

    return rows.mapInArrow(over, schema)


def map_frames(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame | list[tuple]]], schema: str) -> DataFrame:
    """``mapInPandas`` whose integer columns stay integers beside nulls, whatever their size.

    ``run`` yields frames or lists of tuples in the order of the schema; empty ones are left out.
    """
    small_batches(rows.sparkSession)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas(types_mapper=NULLABLE.get) for b in batches):
            yield from _batches(out, made)
        give_back()

    return rows.mapInArrow(over, schema)
