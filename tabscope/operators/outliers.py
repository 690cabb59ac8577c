"""Outliers and invalid values.

Bounds are scalar statistics from one aggregation (quartiles via the exact
bracketed quantiles, mean/std via ``avg``/``stddev_pop``); the row-level test is
then a plain predicate, so flagging or filtering never re-shuffles the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import agg_row
from ..functions.missing import missing_safe, normalize_missing, quote
from ..functions.stats import quantile_map, quantiles
from ..functions.typeclass import categorical_columns, numeric_columns

# Name fragments of measures that must not be negative.
NON_NEGATIVE_HINTS = ["revenue", "sales", "price", "quantity", "amount", "count"]

# Fixed value: the characters that Python's str.strip() removes.
BLANKS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _x(df: DataFrame, name: str) -> Column:
    return missing_safe(df, name).cast("double")


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> dict:
    """``{col: (q1, q3, lower, upper)}`` with linear-interpolated quartiles."""
    norm = normalize_missing(df.select(*[quote(c) for c in cols]))
    qs = quantile_map(norm, cols, [0.25, 0.75], method=method)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_predicate(x: Column, bounds) -> Column:
    _, _, lo, hi = bounds
    if lo is None or math.isnan(lo) or math.isnan(hi):
        return F.lit(False)        # empty column, or quartiles that are infinite: nothing lies outside
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def zscore_stats(df: DataFrame, cols: list[str]) -> dict:
    r = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(_x(df, c)).alias(f"m{i}"), F.stddev_pop(_x(df, c)).alias(f"s{i}"))]).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def zscore_predicate(x: Column, stats, threshold: float = 3.0) -> Column:
    mu, sd = stats
    if mu is None or not sd:
        return F.lit(False)        # constant or empty column: no outliers
    return F.coalesce(F.abs((x - F.lit(mu)) / F.lit(sd)) > F.lit(threshold), F.lit(False))


def outliers_iqr(df: DataFrame, col: str) -> DataFrame:
    """Values outside [q1 − 1.5·IQR, q3 + 1.5·IQR] (D1), one row per offending row."""
    b = iqr_bounds(df, [col])[col]
    x = _x(df, col)
    return df.select(x.alias("value")).filter(iqr_predicate(F.col("value"), b))


def outliers_iqr_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: quartiles, bounds and number of IQR outliers (D1 counts)."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column_name string, q1 double, q3 double, lower double, upper double, outliers bigint")
    bounds = iqr_bounds(df, cols)
    r = agg_row(df, [(f"o{i}", F.count_if(iqr_predicate(_x(df, c), bounds[c])), 1)
                     for i, c in enumerate(cols)])
    rows = [(i, c, *bounds[c], r[f"o{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, q1 double, q3 double, lower double, upper double, outliers bigint")


def outliers_zscore(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """Values with |z| > 3 using the population standard deviation."""
    st = zscore_stats(df, [col])[col]
    x = _x(df, col)
    return df.select(x.alias("value")).filter(zscore_predicate(F.col("value"), st, threshold))


def column_outlier_stats(df: DataFrame, col: str, k: float = 1.5) -> dict:
    """Quartiles, median, IQR fences, mean and population std of one column from a
    single quantile run (mean and std ride along in its first pass)."""
    x = _x(df, col)
    q = quantiles(normalize_missing(df.select(quote(col))), [col], [0.25, 0.5, 0.75],
                  extra=[("_mu", F.avg(x), 2), ("_sd", F.stddev_pop(x), 3)])
    q1, med, q3 = q[(None, col, 0.25)], q[(None, col, 0.5)], q[(None, col, 0.75)]
    ex = q["__extra__"]
    bounds = (None, None, None, None) if q1 is None else (q1, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return {"bounds": bounds, "median": med, "z": (ex["_mu"], ex["_sd"])}


def outlier_flags(df: DataFrame, col: str, iforest: bool = True, seed: int = 42,
                  stats: dict | None = None) -> DataFrame:
    """Row-level flags ``is_iqr``, ``is_z``, ``is_iforest`` and ``is_any``; ``iforest=False`` leaves the forest out."""
    stats = stats or column_outlier_stats(df, col)
    b, st = stats["bounds"], stats["z"]
    x = _x(df, col)
    out = df.withColumn("is_iqr", iqr_predicate(x, b)).withColumn("is_z", zscore_predicate(x, st))
    any_flag = F.col("is_iqr") | F.col("is_z")
    if iforest:
        from .iforest import isolation_forest_flags
        out = isolation_forest_flags(out, col, seed=seed)
        any_flag = any_flag | F.col("is_iforest")
    return out.withColumn("is_any", any_flag)


def outliers_combined(df: DataFrame, col: str, iforest: bool = True, seed: int = 42) -> DataFrame:
    """Sorted distinct outlier values of all methods."""
    f = outlier_flags(df, col, iforest=iforest, seed=seed)
    return (f.filter("is_any").select(_x(f, col).alias("value")).distinct()
            .orderBy("value"))


def outlier_flag(df: DataFrame, col: str, iforest: bool = True, flag_col: str = "is_outlier") -> DataFrame:
    """``Outlier``/``Normal`` label column by the combined outlier test."""
    own = [c for c in df.columns if c != flag_col]
    # the caller's columns travel as one, so none shares a name with a flag
    packed = df.select(F.struct(*[F.col(quote(c)) for c in own]).alias("row"), _x(df, col).alias("x"))
    f = outlier_flags(packed, "x", iforest=iforest)
    return f.select("row.*", F.when(F.col("is_any"), F.lit("Outlier")).otherwise(F.lit("Normal")).alias(flag_col))


def negative_values(df: DataFrame) -> DataFrame:
    """Negative counts in numeric columns whose name suggests a non-negative measure."""
    cols = [c for c in numeric_columns(df) if any(h in c.lower() for h in NON_NEGATIVE_HINTS)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, negative_count bigint")
    r = agg_row(df, [(f"n{i}", F.count_if(_x(df, c) < 0), 1) for i, c in enumerate(cols)])
    return df.sparkSession.createDataFrame([(c, r[f"n{i}"]) for i, c in enumerate(cols)],
                                           "column_name string, negative_count bigint")


def strip_ws(x: Column) -> Column:
    """Python's ``str.strip()``: all leading/trailing whitespace, not just ASCII's."""
    return F.regexp_replace(x, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def whitespace_issues(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column: values with leading/trailing whitespace and one example."""
    cols = categorical_columns(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, affected bigint, example string")
    named = []
    for i, c in enumerate(cols):
        v = F.col(quote(c))
        bad = v.isNotNull() & (v != strip_ws(v))
        named += [(f"n{i}", F.count_if(bad), 1), (f"e{i}", F.min(F.when(bad, v)), 1)]
    r = agg_row(df, named)
    return df.sparkSession.createDataFrame([(c, r[f"n{i}"], r[f"e{i}"]) for i, c in enumerate(cols)],
                                           "column_name string, affected bigint, example string")


def outlier_compare(df: DataFrame, col: str, iforest: bool = True, k: float = 1.5) -> DataFrame:
    """Outlier rows vs normal rows on every other numeric column.

    Per column: outlier mean, normal mean and normal sample std; ``distinct`` when
    the std is positive and the means differ by more than ``k`` stds. Empty when
    either group is empty or there is no other numeric column."""
    others = [c for c in numeric_columns(df) if c != col]
    schema = ("position int, column_name string, outlier_mean double, normal_mean double, "
              "normal_std double, is_distinct boolean, direction string")
    if not others:
        return df.sparkSession.createDataFrame([], schema)
    f = outlier_flags(df, col, iforest=iforest)
    out_flag = F.col("is_any")
    named = [("_no", F.count_if(out_flag), 1), ("_nn", F.count_if(~out_flag), 1)]
    for i, c in enumerate(others):
        x = _x(f, c)
        named += [(f"o{i}", F.avg(F.when(out_flag, x)), 2), (f"m{i}", F.avg(F.when(~out_flag, x)), 2),
                  (f"s{i}", F.stddev_samp(F.when(~out_flag, x)), 3)]
    r = agg_row(f, named)
    rows = []
    if r["_no"] > 0 and r["_nn"] > 0:
        for i, c in enumerate(others):
            om, nm, ns = r[f"o{i}"], r[f"m{i}"], r[f"s{i}"]
            distinct = bool(ns and ns > 0 and om is not None and nm is not None and abs(om - nm) > k * ns)
            rows.append((i, c, om, nm, ns, distinct,
                         ("higher" if om > nm else "lower") if distinct else None))
    return df.sparkSession.createDataFrame(rows, schema)


def outlier_verdict(compare: DataFrame) -> DataFrame:
    """behavioural (some column distinct) vs statistical outliers, from ``outlier_compare``."""
    return compare.agg(F.when(F.bool_or("is_distinct"), F.lit("behavioural"))
                       .otherwise(F.lit("statistical")).alias("verdict"),
                       F.count_if("is_distinct").alias("distinct_columns"))
