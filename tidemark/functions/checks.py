"""Checks of keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_key_type(df: DataFrame, key: str) -> None:
    """Keys need a total order under which equal keys are the same: no floating point, no maps."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.MapType)):
        raise TypeError(f"{kind.simpleString()} can't be a key: {key}")


def serialized_size(col: Column) -> Column:
    """Bytes of a value: 8 for each number in it, else those of its text or binary form."""
    return F.coalesce(F.octet_length(col.cast("string")), F.lit(0)).cast("long")


def fixed_size(kind: T.DataType, col: Column) -> Column:
    """Serialized bytes of a column: its width if the type has one; arrays have 8 bytes of length before their elements."""
    if isinstance(kind, (T.ByteType, T.BooleanType)):
        return F.lit(1)
    if isinstance(kind, (T.ShortType,)):
        return F.lit(2)
    if isinstance(kind, (T.IntegerType, T.FloatType, T.DateType)):
        return F.lit(4)
    if isinstance(kind, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(8)
    if isinstance(kind, T.DecimalType):
        return F.lit(8 if kind.precision <= 20 else 16)
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(col, F.array().cast(kind)), F.lit(8), lambda acc, x: acc + fixed_size(kind.elementType, x))
    if isinstance(kind, T.StructType):
        return sum((fixed_size(f.dataType, col[f.name]) for f in kind.fields), F.lit(0))
    return F.coalesce(F.octet_length(col), F.lit(0)) + 8


def check_size(kind: T.DataType, col: Column, most: int, what: str) -> Column:
    """The column itself; an error for a row whose value takes more than `most` bytes."""
    return F.when(fixed_size(kind, col) > most, F.raise_error(F.lit(f"{what} of more than {most} bytes"))).otherwise(col)
