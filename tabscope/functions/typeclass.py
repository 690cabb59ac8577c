"""Column type classes, decided from the schema on the driver (metadata only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, NUMERIC_TYPES)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Numeric columns in column order (booleans only when asked, as pandas'
    ``is_numeric_dtype`` does; ``select_dtypes(np.number)`` excludes them)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, include_bool)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def type_class(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Project the columns of one type class, keeping column order (op C1)."""
    if kind == "numeric":
        cols = numeric_columns(df)
    elif kind == "categorical":
        cols = categorical_columns(df)
    elif kind == "datetime":
        cols = datetime_columns(df)
    else:
        raise ValueError(f"unknown type class {kind!r}")
    from .missing import quote
    return df.select(*[F.col(quote(c)) for c in cols])
