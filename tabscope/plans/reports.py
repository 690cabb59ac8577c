"""Composite reports M2–M7 (M1 is ``audit``): each is one public function that
composes the operators; every part stays a lazy DataFrame until the caller
acts on it, and text findings are built from small aggregate results only."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import missing_safe, normalize_missing
from ..functions.stats import kurt_bias_corrected, quantiles, skew_bias_corrected, with_k2
from ..functions.typeclass import NESTED_TYPES, is_numeric_type, numeric_columns
from ..operators import chartdata, detect, outliers, profile, timeseries
from .audit import audit_checks, audit_findings
from .eda import eda_numeric_extras, eda_report
from .findings import finding, findings_frame


# ------------------------------------------------------------------ M2 insights

def insights_findings(df: DataFrame, vc: DataFrame | None = None, stats: dict | None = None) -> list[tuple]:
    df = normalize_missing(df)
    out = []
    summary_df, n = profile.table_summary_and_rows(df, vc, stats)  # the row count rides along
    ncols = len(df.columns)
    out.append(finding("shape", None, "rows", "info", n, f"{n} rows"))
    out.append(finding("shape", None, "columns", "info", ncols, f"{ncols} columns"))
    summary = summary_df.collect()                          # one row per column
    for r in summary:
        out.append(finding("columns", r["column_name"], "summary", "info", r["unique_values"],
                           r["description"]))
    t = detect.detect_time_column(df).collect()
    if t:
        col, fmt = t[0]["column_name"], t[0]["format"]
        s = profile.time_span(df, col, fmt).first()
        out.append(finding("time", col, "time_span", "info", s["days"],
                           f"{s['start']:%Y-%m-%d} to {s['end']:%Y-%m-%d}" if s["start"] else None))
    else:
        out.append(finding("time", None, "time_span", "info", None, "no time column detected"))
    # ID detection (R1) and granularity (A29) reuse the distinct counts of the summary
    unique = {r["column_name"]: r["unique_values"] for r in summary}
    idc = next((c for c in df.columns if c in unique and any(h in c.lower() for h in detect.ID_HINTS)
                and n and unique[c] / n > 0.8), None)
    if idc:
        label = "one row per id" if unique[idc] == n else "several rows per id"
        out.append(finding("granularity", idc, "granularity", "info", unique[idc], label))
    else:
        out.append(finding("granularity", None, "granularity", "info", None, "no ID column detected"))
    return out


def insights_report(df: DataFrame, vc: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    return findings_frame(df.sparkSession, insights_findings(df, vc, stats))


# ------------------------------------------------------------------ M3 cleaning suggestions

def cleaning_suggestions(df: DataFrame, audit_rows: list[tuple] | None = None) -> DataFrame:
    """Suggested actions: impute per missing column (median/mean for numbers,
    mode/'Unknown' otherwise) and removal of duplicate rows. With the audit's
    findings at hand (``audit_rows``) nothing is scanned again."""
    df = normalize_missing(df)
    kinds = {f.name: is_numeric_type(f.dataType, include_bool=True) for f in df.schema.fields}
    if audit_rows is None:
        miss = [(r["column_name"], r["missing_count"]) for r in profile.missing_summary(df).collect()]
        dup = profile.duplicate_count(df).first()[0]
    else:
        miss = []
        for sec, col, check, _, metric, detail in audit_rows:
            if sec == "missing" and check == "missing_values" and col is not None:
                miss.append((col, int(detail.split(" ", 1)[0])))
        dup = int(next(m for sec, _, check, _, m, _ in audit_rows if check == "duplicate_rows"))
    out = []
    if not miss:
        out.append(finding("cleaning", None, "missing_values", "success", 0, "nothing to impute"))
    for c, k in miss:
        if kinds[c]:
            out.append(finding("cleaning", c, "impute", "info", k, "median or mean"))
        else:
            out.append(finding("cleaning", c, "impute", "info", k, "mode or 'Unknown'"))
    out.append(finding("cleaning", None, "duplicates", "warning" if dup > 0 else "success", dup,
                       "remove duplicate rows" if dup > 0 else "no duplicate rows"))
    return findings_frame(df.sparkSession, out)


# ------------------------------------------------------------------ M6 column report

def column_report(df: DataFrame, col: str, iforest: bool = True) -> DataFrame:
    """One-row statistical and anomaly report of a numeric column (M6)."""
    df = normalize_missing(df)
    stats = outliers.column_outlier_stats(df, col)
    med = stats["median"]
    flags = outliers.outlier_flags(df, col, iforest=iforest, stats=stats)
    xf = missing_safe(flags, col).cast("double")
    sd = F.stddev_pop(xf)
    agg = flags.agg(
        F.avg(xf).alias("mean"), F.stddev_samp(xf).alias("std"), F.min(xf).alias("min"),
        F.max(xf).alias("max"), F.count_if(xf.isNull()).alias("missing"), F.count(xf).alias("n"),
        F.when(sd > 0, F.skewness(xf)).alias("g1"), F.when(sd > 0, F.kurtosis(xf)).alias("g2"),
        F.count_if("is_iqr").alias("iqr_outliers"), F.count_if("is_z").alias("z_outliers"),
        F.count_distinct(F.when(F.col("is_any"), xf)).alias("combined_outliers"))
    skew = skew_bias_corrected(F.col("n"), F.col("g1"))
    agg = with_k2(agg, "n", "g1", "g2", "_stat", "_p")
    p = F.when(F.col("n") > 8, F.col("_p"))
    return agg.select(F.lit(col).alias("column_name"), "mean", F.lit(med).cast("double").alias("median"),
                      "std", "min", "max", "missing", skew.alias("skewness"),
                      kurt_bias_corrected(F.col("n"), F.col("g2")).alias("kurtosis"),
                      profile.skew_label(skew).alias("skew_label"), p.alias("p_value"),
                      (p >= 0.05).alias("is_normal"), "iqr_outliers", "z_outliers",
                      "combined_outliers")


def column_report_parts(df: DataFrame, col: str, iforest: bool = True) -> dict:
    """All parts of the full column report: stats row, histogram, box, comparison."""
    return {
        "summary": column_report(df, col, iforest),
        "histogram": chartdata.histogram(df, col),
        "box": chartdata.box_stats(df, col),
        "outlier_compare": outliers.outlier_compare(df, col, iforest=iforest),
    }


# ------------------------------------------------------------------ M4 exploratory analysis

def eda_findings(df: DataFrame, parts: dict | None = None) -> DataFrame:
    """A findings view of the exploratory analysis: four-number summaries, the
    most common value of each text column and the top correlated pairs."""
    parts = eda_report(df) if parts is None else parts
    out = []
    if "numeric_summary" in parts:
        for r in parts["numeric_summary"].collect():
            out.append(finding("eda", r["column_name"], "mean", "info", r["mean"], None))
            out.append(finding("eda", r["column_name"], "median", "info", r["median"], None))
    if "value_counts" in parts:
        for r in parts["value_counts"].filter(F.col("rank") == 1).collect():
            out.append(finding("eda", r["column_name"], "top_category", "info", r["count"], str(r["value"])))
    if "top_corr_pairs" in parts:
        for r in parts["top_corr_pairs"].collect():
            out.append(finding("eda", r["col_a"], "correlated_with", "info", r["r"], r["col_b"]))
    return findings_frame(df.sparkSession, out)


# ------------------------------------------------------------------ M5 time-based analysis

def time_series_daily(df: DataFrame) -> DataFrame:
    """The daily series of the detected time and value columns (M5 core); empty
    when no suitable columns exist."""
    parts = time_analysis(df)
    if not parts:
        return df.sparkSession.createDataFrame([], "day date, raw_mean double, observed double")
    return parts["daily"]


def time_analysis(df: DataFrame, ranges: dict | None = None) -> dict:
    """Parts of the time-based analysis (M5); empty when no time/value columns exist
    or the daily series has fewer than two days."""
    df = normalize_missing(df)
    tv = detect.detect_ts_columns(df, ranges).collect()
    if not tv:
        return {}
    tcol, vcol = tv[0]["time_column"], tv[0]["value_column"]
    fmt = None
    if not isinstance(df.schema[tcol].dataType, tuple(detect.DATETIME_TYPES)):
        fmt = detect.parse_status(df, [tcol])[tcol][1]
    daily = timeseries.daily_resample(df, tcol, vcol, fmt).cache()
    if daily.count() < 2:
        return {}
    return {"daily": daily, "decomposition": timeseries.seasonal_decompose(daily),
            "monthly": timeseries.monthly_pattern(daily), "weekday": timeseries.weekday_pattern(daily)}


# ------------------------------------------------------------------ M7 one click

def one_click_report(df: DataFrame) -> dict:
    """Audit → insights → cleaning → exploratory → time-based, in that order (M7).
    The cleaning suggestions reuse the audit's counts."""
    df = normalize_missing(df)
    spark = df.sparkSession
    # one value-count shuffle over all columns serves the audit, the summary and the EDA
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]
    vc = profile.value_counts_long(df, cols, rows=True, compact=True).persist(StorageLevel.MEMORY_AND_DISK)
    # one quantile run (with the audit's checks and the EDA's column statistics in
    # its first pass) serves both sections
    nums = numeric_columns(df)
    numeric = (quantiles(df, nums, [0.25, 0.5, 0.75], extra=audit_checks(df) + eda_numeric_extras(df, nums)
                         + profile.table_summary_aggregates(df))
               if nums else None)
    audit_rows = audit_findings(df, vc=vc, numeric=numeric)
    return {"audit": findings_frame(spark, audit_rows),
            "insights": insights_report(df, vc, numeric["__extra__"] if numeric else None),
            "cleaning": cleaning_suggestions(df, audit_rows),
            "eda": eda_report(df, vc=vc, numeric=numeric),
            "time": time_analysis(df, _ranges(numeric, nums)),
            "value_counts_core": vc}


def _ranges(numeric: dict | None, nums: list[str]) -> dict | None:
    """``{col: (min, max)}`` from the shared quantile run's extra statistics."""
    if not numeric:
        return None
    ex = numeric["__extra__"]
    return {c: (ex[f"lo{i}"], ex[f"hi{i}"]) for i, c in enumerate(nums)}


def one_click_findings(df: DataFrame) -> DataFrame:
    """The text sections of the one-click report as one findings table."""
    rep = one_click_report(df)
    vc = rep["value_counts_core"]
    out = rep["audit"].unionByName(rep["insights"]).unionByName(rep["cleaning"])
    out = out.unionByName(eda_findings(df, rep["eda"]))
    ts = rep["time"]
    if ts:
        daily = ts["daily"]
        s = daily.agg(F.count(F.lit(1)).alias("days"), F.avg("observed").alias("m")).first()
        out = out.unionByName(findings_frame(df.sparkSession, [
            finding("time", None, "daily_points", "info", s["days"], None),
            finding("time", None, "daily_mean", "info", s["m"], None)]))
    # every section above is built from collected summaries, so the shared table can go
    vc.unpersist()
    return out
