"""Time series (T1–T8): daily resample with forward fill, additive decomposition,
monthly and weekday patterns.

The raw table is reduced to one row per calendar day by a distributed
aggregation first (partial aggregation before the shuffle, so a day holding a
third of all rows costs no more than any other). Everything after that works on
the day-grain table, whose size is bounded by the number of days in the span,
not by the data; only there are un-partitioned (ordered) windows used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import to_timestamp_any
from ..functions.missing import missing_safe

# Weekday and month names in calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def daily_means(df: DataFrame, time_col: str, value_col: str, fmt: str | None = None) -> DataFrame:
    """Mean of ``value_col`` per calendar day that has rows (T1 + first half of T2)."""
    day = F.to_date(to_timestamp_any(df, time_col, fmt))
    v = missing_safe(df, value_col).cast("double")
    return (df.select(day.alias("day"), v.alias("v")).filter(F.col("day").isNotNull())
            .groupBy("day").agg(F.avg("v").alias("mean")))


def daily_resample(df: DataFrame, time_col: str, value_col: str, fmt: str | None = None) -> DataFrame:
    """Every day from the first to the last, mean per day, gaps forward-filled.

    ``observed`` is the filled value; ``raw_mean`` is NULL on days without data."""
    return fill_calendar(daily_means(df, time_col, value_col, fmt))


def _grain_start(t, grain: str):
    """Beginning of the minute, hour, day, week or month of a TIMESTAMP_NTZ, whatever the session's time zone."""
    if grain in ("minute", "hour"):
        minute = F.minute(t) if grain == "minute" else F.lit(0)
        return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), minute, F.lit(0))
    if grain in ("day", "week", "month"):
        day = F.to_date(t)
        return (day if grain == "day" else F.to_date(F.trunc(day, grain))).cast("timestamp_ntz")
    raise ValueError(f"unknown grain: {grain}")


def time_line(df: DataFrame, time_col: str, value_col: str, grain: str = "hour", fmt: str | None = None) -> DataFrame:
    """The value against time (T8): all rows in order of time, as mean, least, largest and
    number of values per ``grain`` that has rows; no row is sampled and no gap is filled."""
    v = missing_safe(df, value_col).cast("double")
    rows = df.select(to_timestamp_any(df, time_col, fmt).alias("_t"), v.alias("v")).filter(F.col("_t").isNotNull())
    return (rows.groupBy(_grain_start(F.col("_t"), grain).alias("time"))
            .agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
            .orderBy("time"))


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Day-grain ``(day, mean)`` → every calendar day between the first and last,
    with ``raw_mean`` and the forward-filled ``observed`` (bounded by the span)."""
    span = daily.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    calendar = span.select(F.explode(F.sequence("d0", "d1")).alias("day"))
    filled = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (calendar.join(daily.select("day", "mean"), "day", "left")
            .select("day", F.col("mean").alias("raw_mean"),
                    F.last("mean", ignorenulls=True).over(filled).alias("observed")))


def seasonal_decompose(daily: DataFrame, period: int = 7, min_span_days: int = 14) -> DataFrame:
    """Additive decomposition of a daily series (T4/T5) — statsmodels' recipe:
    centred moving average trend (missing at both ends), phase means of the
    detrended series centred to sum to zero, residual = detrended − seasonal.
    Empty unless the series spans more than ``min_span_days`` days."""
    d = daily.select("day", F.col("observed"))
    order = Window.orderBy("day")
    half = period // 2
    if period % 2 == 1:
        trend = F.when(F.count("observed").over(order.rowsBetween(-half, half)) == period,
                       F.avg("observed").over(order.rowsBetween(-half, half)))
    else:   # 2×period moving average with half weights at both ends
        full = order.rowsBetween(-half, half)
        trend = F.when(F.count("observed").over(full) == period + 1,
                       (F.sum("observed").over(full)
                        - 0.5 * F.first("observed").over(full) - 0.5 * F.last("observed").over(full)) / period)
    d0 = F.min("day").over(Window.partitionBy())
    span = F.datediff(F.max("day").over(Window.partitionBy()), d0)
    base = (d.withColumn("trend", trend)
            .withColumn("phase", F.pmod(F.datediff("day", d0), F.lit(period)))
            .withColumn("_span", span)
            .filter(F.col("_span") > min_span_days)
            .withColumn("detrended", F.col("observed") - F.col("trend")))
    phase_means = base.groupBy("phase").agg(F.avg("detrended").alias("_pm"))   # ≤ period rows
    centred = phase_means.select("phase", (F.col("_pm") - F.avg("_pm").over(Window.partitionBy()))
                                 .alias("seasonal"))
    return (base.join(F.broadcast(centred), "phase")
            .select("day", "observed", "trend", "seasonal",
                    (F.col("detrended") - F.col("seasonal")).alias("resid"), "phase")
            .orderBy("day"))


def monthly_pattern(daily: DataFrame) -> DataFrame:
    """Mean of the filled daily series per calendar month, in month order."""
    return (daily.groupBy(F.month("day").alias("month"))
            .agg(F.avg("observed").alias("mean"), F.min("day").alias("_d"))
            .select("month", F.date_format("_d", "MMMM").alias("month_name"), "mean")
            .orderBy("month"))


def weekday_pattern(daily: DataFrame) -> DataFrame:
    """Mean of the filled daily series per weekday, Monday…Sunday; weekdays without
    data stay in the table with a NULL mean (T7)."""
    means = daily.groupBy(F.weekday("day").alias("weekday")).agg(F.avg("observed").alias("mean"))
    spark = daily.sparkSession
    names = spark.createDataFrame(list(enumerate(WEEKDAYS)), "weekday int, weekday_name string")
    return (names.join(means, "weekday", "left")
            .select("weekday", "weekday_name", "mean").orderBy("weekday"))
