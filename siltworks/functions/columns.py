"""Column classes and the one notion of a missing value that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that none of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dtype(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    return df.schema[name].dataType


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def type_class(kind: T.DataType) -> str:
    """string, numeric, boolean, temporal or other."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if is_numeric(kind):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "temporal" if isinstance(kind, TEMPORAL) else "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(dtype(df, name), FLOATING) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def usable(df: DataFrame, name: str) -> Column:
    """The value, null where missing: NaN must not reach an aggregate."""
    return F.when(present(df, name), col(name))


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text, missing as null; nested values as JSON."""
    kind = dtype(df, name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(col(name))
    if isinstance(kind, T.BinaryType):
        return F.hex(col(name))
    return usable(df, name).cast("string")
