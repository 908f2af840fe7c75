"""Anything that a comparison accepts as a table, as a DataFrame."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import Side, TableConversionError
from tessera.types import Kind, field_of, from_arrow


def _held(k: Kind) -> pa.DataType:
    """The Arrow type of a logical type's physical values."""
    if k.name == "uint":
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[k.bits]
    if k.name == "int":
        return {8: pa.int8(), 16: pa.int16(), 32: pa.int32(), 64: pa.int64()}[k.bits]
    if k.name == "float":
        return pa.float64() if k.bits == 64 else pa.float32()
    if k.name == "decimal":
        return pa.decimal128(k.precision, k.scale)
    if k.name == "timestamp":
        return pa.int64() if k.unit == "ns" else pa.timestamp("us", k.zone and "UTC")
    if k.name == "time":
        return pa.int64() if k.unit == "ns" else pa.time64("us")
    if k.name in ("list", "fixed_list"):
        return pa.list_(_held(k.child(0)))
    if k.name == "map":
        return pa.map_(_held(k.child(0)), _held(k.child(1)))
    if k.name == "struct":
        return pa.struct([pa.field(n, _held(c)) for n, c, _ in k.children])
    plain = {"null": pa.null(), "bool": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "fixed_binary": pa.binary(),
             "date": pa.date32(), "duration": pa.duration("us")}
    if k.name not in plain:
        raise TypeError(f"Spark cannot hold columns of type {k}")
    return plain[k.name]


def _physical(a: pa.ChunkedArray, k: Kind) -> pa.ChunkedArray:
    if k.name == "timestamp" and k.unit == "ns" or k.name == "time" and k.unit == "ns":
        return a.cast(pa.int64())
    if k.name == "time" and k.unit in ("s", "ms"):
        return a.cast(pa.time32("ms")).cast(pa.time64("us"))
    return a.cast(_held(k))


def from_arrow_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A DataFrame that remembers the logical type of each column; names may repeat."""
    kinds = [from_arrow(f.type) for f in table.schema]
    names = [f"c{i}" for i in range(len(kinds))]
    fields = [field_of(n, k) for n, k in zip(table.schema.names, kinds)]
    if not kinds:
        return spark.createDataFrame([()] * table.num_rows, T.StructType([]))
    arrays = [_physical(table.column(i), k) for i, k in enumerate(kinds)]
    schema = T.StructType([T.StructField(n, f.dataType, True, f.metadata) for n, f in zip(names, fields)])
    return spark.createDataFrame(pa.table(arrays, names=names), schema).toDF(*table.schema.names)


def to_df(value: Any, side: Side, spark: SparkSession | None = None) -> DataFrame:
    """From a DataFrame, an Arrow table, or what has ``to_df`` or ``to_arrow``."""
    try:
        if isinstance(value, DataFrame):
            return value
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if isinstance(value, pa.Table):
            return from_arrow_table(spark, value)
        if callable(getattr(value, "to_df", None)):
            return value.to_df(spark)
        if callable(getattr(value, "to_arrow", None)):
            return from_arrow_table(spark, value.to_arrow())
    except Exception as e:
        raise TableConversionError(side, e) from e
    raise TableConversionError(side, TypeError(f"{type(value).__name__} is no DataFrame, Arrow table or fixture"))
