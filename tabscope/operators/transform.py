"""Cleaning and derived columns (C2–C17): DataFrame in, DataFrame out.

Every transform is a projection (no shuffle) once its statistics are known;
statistics (mean, median, mode, min/max, top-N) are one small aggregation whose
single row becomes literals of the projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import best_formats, parse_mixed, to_timestamp_any
from ..functions.missing import is_missing, missing_safe, quote
from ..functions.stats import quantile_map
from ..functions.typeclass import is_numeric_type
from ..functions.numbers import numeric_text
from .profile import mode_value, top_values


def _col(name: str) -> Column:
    return F.col(quote(name))


def _replace(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Replace one column in place, keeping column order."""
    return df.select(*[expr.alias(c) if c == name else _col(c) for c in df.columns])


def _require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def _require_new(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")


# ------------------------------------------------------------------ C2 drop

def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    _require(df, *cols)
    return df.select(*[_col(c) for c in df.columns if c not in set(cols)])


# ------------------------------------------------------------------ C3/C4 types

def numeric_expr(df: DataFrame, name: str, target: str = "double") -> Column:
    dt = df.schema[name].dataType
    if is_numeric_type(dt, include_bool=True):
        return missing_safe(df, name).cast(target)
    v = F.trim(_col(name).cast("string"))
    parsed = numeric_text(v, target)
    if target == "double":
        parsed = F.when(F.isnan(parsed), F.lit(None)).otherwise(parsed)
    return parsed


def convert_type(df: DataFrame, name: str, target: str, fmt: str | None = None,
                 mixed: bool = False) -> DataFrame:
    """Retype one column (C3): numeric/float → double, int → bigint, datetime →
    timestamp_ntz (best listed format, or any with ``mixed``), string, category
    (values kept; see ``category_codes`` for the codes). Failures become NULL."""
    _require(df, name)
    if target in ("numeric", "float"):
        return _replace(df, name, numeric_expr(df, name, "double"))
    if target == "int":
        return _replace(df, name, numeric_expr(df, name, "bigint"))
    if target == "datetime":
        if isinstance(df.schema[name].dataType, T.StringType):
            if mixed:
                return _replace(df, name, parse_mixed(_col(name)))
            fmt = fmt or best_formats(df, [name])[name][0]
        return _replace(df, name, to_timestamp_any(df, name, fmt))
    if target == "string":
        return _replace(df, name, missing_safe(df, name).cast("string"))
    if target == "category":
        return df
    raise ValueError(f"unsupported target type {target!r}")


def conversion_report(df: DataFrame, name: str, target: str, **kw) -> DataFrame:
    """How many values became missing through ``convert_type`` (one aggregation)."""
    # the conversion is a per-row projection, so both states are counted in one pass
    expr = convert_type(df.withColumn("__orig_missing", is_missing(df, name)), name, target, **kw)
    return expr.agg(F.lit(name).alias("column_name"), F.lit(target).alias("target"),
                    F.count_if(F.col(quote(name)).isNull() & ~F.col("__orig_missing"))
                    .alias("newly_missing"))


def category_codes(df: DataFrame, name: str, code_col: str | None = None) -> DataFrame:
    """Dense codes of the sorted distinct values (C4); missing → −1.

    The code table is built from the distinct values with a range-partitioned
    global position (no single-task window); it is broadcast only when its
    counted bytes are under the broadcast limit, otherwise joined by shuffle."""
    from ..functions.ordering import with_global_position
    _require(df, name)
    code_col = code_col or f"{name}_code"
    _require_new(df, code_col)
    # the caller's columns travel as one, so none shares a name with the code table's
    packed = df.select(F.struct(*[_col(c) for c in df.columns]).alias("row"), missing_safe(df, name).alias("key"))
    distinct = packed.select(F.col("key").alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    codes = with_global_position(distinct, [F.col("_v").asc()], pos="_code")
    size = codes.agg(F.sum(F.octet_length(F.col("_v").cast("string")) + F.lit(16))).first()[0] or 0
    table = F.broadcast(codes) if size <= CODE_TABLE_BROADCAST_BYTES else codes
    joined = packed.join(table, F.col("key") == F.col("_v"), "left")   # missing values match nothing and stay out
    return joined.select("row.*", F.coalesce(F.col("_code"), F.lit(-1)).cast("bigint").alias(code_col))


# Bytes of the largest code table (value, code) broadcast to the join; larger ones are shuffle-joined.
CODE_TABLE_BROADCAST_BYTES = 64 << 20


# ------------------------------------------------------------------ C5 categories

def standardize_categories(df: DataFrame, name: str, values: list, new_value) -> DataFrame:
    _require(df, name)
    c = _col(name)
    return _replace(df, name, F.when(c.isin(list(values)), F.lit(new_value)).otherwise(c))


# ------------------------------------------------------------------ C6–C8 derived

def derive_numeric(df: DataFrame, a: str, op: str, b: str, new_name: str) -> DataFrame:
    """``a op b`` as a new DOUBLE column (C6/C7); ``/`` adds 1e-9 to the divisor."""
    _require(df, a, b)
    _require_new(df, new_name)
    x, y = missing_safe(df, a).cast("double"), missing_safe(df, b).cast("double")
    if op == "+":
        e = x + y
    elif op == "-":
        e = x - y
    elif op == "*":
        e = x * y
    elif op == "/":
        e = F.try_divide(x, y + F.lit(1e-9))
    else:
        raise ValueError(f"unsupported operation {op!r}")
    return df.withColumn(new_name, e)


# The datetime parts offered, and their column suffixes.
DATETIME_PARTS = ["Year", "Month", "Day", "Quarter", "Day of Week", "Day Name", "Week of Year"]


def datetime_parts(df: DataFrame, name: str, parts: list[str] | None = None,
                   fmt: str | None = None) -> DataFrame:
    """New ``{name}_{part}`` columns (C8); Day of Week has Monday = 0, Week of Year is ISO."""
    _require(df, name)
    parts = parts or DATETIME_PARTS
    if isinstance(df.schema[name].dataType, T.StringType) and fmt is None:
        fmt = best_formats(df, [name])[name][0]
    ts = to_timestamp_any(df, name, fmt)
    exprs = {
        "Year": F.year(ts), "Month": F.month(ts), "Day": F.dayofmonth(ts),
        "Quarter": F.quarter(ts), "Day of Week": F.weekday(ts),
        "Day Name": F.date_format(ts, "EEEE"), "Week of Year": F.weekofyear(ts),
    }
    out = df
    for p in parts:
        if p not in exprs:
            raise ValueError(f"unknown datetime part {p!r}")
        out = out.withColumn(f"{name}_{p.lower().replace(' ', '_')}", exprs[p])
    return out


def equal_width_bin(x: Column, lo: float | None, hi: float | None, n: int) -> Column:
    """``pd.cut(bins=n, labels=False, include_lowest=True)``: right-closed bins."""
    if lo is None or hi is None:
        return F.lit(None).cast("bigint")
    if lo == hi:
        return F.when(x.isNotNull(), F.lit((n - 1) // 2)).cast("bigint")
    w = (hi - lo) / n
    b = F.greatest(F.ceil((x - F.lit(lo)) / F.lit(w)) - 1, F.lit(0))
    return F.when(x.isNotNull(), F.least(b, F.lit(n - 1))).cast("bigint")


def bin_equal_width(df: DataFrame, name: str, n: int, new_name: str) -> DataFrame:
    """Equal-width bin index 0..n−1 of a numeric column (C9); infinite values have no bin width and raise."""
    _require(df, name)
    _require_new(df, new_name)
    x = missing_safe(df, name).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if r["lo"] is not None and math.isinf(r["hi"] - r["lo"]):
        raise ValueError(f"column {name!r} has infinite values and no equal-width bins")
    return df.withColumn(new_name, equal_width_bin(x, r["lo"], r["hi"], n))


# ------------------------------------------------------------------ C10–C14 missing

def handle_missing(df: DataFrame, name: str, strategy: str, fill_value=None) -> DataFrame:
    """mean / median / mode imputation, constant fill, or dropping rows."""
    _require(df, name)
    v = missing_safe(df, name)
    dt = df.schema[name].dataType
    if strategy == "mean":
        fill = df.agg(F.avg(v.cast("double"))).first()[0]
    elif strategy == "median":
        fill = quantile_map(df.select(v.alias("x")), ["x"], [0.5])["x"][0]
    elif strategy == "mode":
        fill = mode_value(df, name)
    elif strategy == "constant":
        if fill_value is None:
            raise ValueError("a fill value is required")
        conv = df.sparkSession.range(1).select(F.lit(fill_value).try_cast(dt).alias("v")).first()[0]
        if conv is None:
            raise ValueError(f"cannot convert {fill_value!r} to {dt.simpleString()}")
        fill = conv
    elif strategy == "drop":
        return df.filter(v.isNotNull())
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if fill is None:
        return _replace(df, name, v)
    lit = F.lit(fill)
    if is_numeric_type(dt) and strategy in ("mean", "median") and not isinstance(
            dt, (T.FloatType, T.DoubleType)):
        return _replace(df, name, F.coalesce(v.cast("double"), lit.cast("double")))
    return _replace(df, name, F.coalesce(v, lit.cast(dt)))


# ------------------------------------------------------------------ C15/C16 scaling

def scale(df: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """Standard (population std) or min-max scaling; a constant column becomes 0."""
    _require(df, *cols)
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = missing_safe(df, c).cast("double")
        if kind == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif kind == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        else:
            raise ValueError(f"unknown scaler {kind!r}")
    r = df.agg(*aggs).first()
    out = df
    for i, c in enumerate(cols):
        x = missing_safe(df, c).cast("double")
        a, b = r[f"a{i}"], r[f"b{i}"]
        if a is None:
            e = x
        elif not b:
            e = F.when(x.isNotNull(), F.lit(0.0))
        else:
            e = (x - F.lit(a)) / F.lit(b)
        out = _replace(out, c, e)
    return out


# ------------------------------------------------------------------ C17 rare categories

def collapse_rare(df: DataFrame, name: str, top_n: int = 20, other: str = "Other") -> DataFrame:
    """Keep the ``top_n`` most frequent values, everything else (missing included)
    becomes ``other``; nothing changes when the column has ≤ ``top_n`` values."""
    _require(df, name)
    top = top_values(df, name, top_n + 1)
    if len(top) <= top_n:
        return df
    keep = top[:top_n]
    v = missing_safe(df, name)
    return _replace(df, name, F.when(v.isin(keep), v.cast("string")).otherwise(F.lit(other)))


def filter_top_categories(df: DataFrame, name: str, n: int = 15) -> DataFrame:
    """Rows whose ``name`` is among the ``n`` most frequent values."""
    top = top_values(df, name, n)
    return df.filter(missing_safe(df, name).isin(top))
