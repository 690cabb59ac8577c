"""Missing-value normalisation.

pandas treats NaN, None and NaT alike as missing and every aggregate skips
them; Spark keeps NaN as a value (avg/max/corr become NaN, count_distinct counts
it). Every operator therefore starts from ``normalize_missing`` so that the rest
of the engine only ever sees NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def missing_safe(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL (other types unchanged)."""
    col = F.col(quote(name))
    if _is_float(df.schema[name].dataType):
        return F.when(F.isnan(col), F.lit(None)).otherwise(col)
    return col


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN → NULL on every float/double column; a pure projection (no shuffle)."""
    if not any(_is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[missing_safe(df, f.name).alias(f.name) for f in df.schema.fields])


def is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(quote(name))
    if _is_float(df.schema[name].dataType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def quote(name: str) -> str:
    """Backtick-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"
