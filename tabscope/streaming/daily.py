"""Daily means over a stream: 1-day tumbling event-time windows with a
watermark, so state for a day is dropped once no more late rows can arrive.
The calendar fill and forward fill of T2 run on the (day-grain) result table
with ``operators.timeseries.fill_calendar``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.missing import missing_safe, quote


def daily_means_stream(stream: DataFrame, time_col: str, value_col: str,
                       watermark: str = "2 days") -> DataFrame:
    """``(day, mean, rows)`` per event-time day of a streaming DataFrame."""
    t = F.col(quote(time_col)).cast("timestamp")
    v = missing_safe(stream, value_col).cast("double")
    return (stream.select(t.alias("_t"), v.alias("_v")).filter(F.col("_t").isNotNull())
            .withWatermark("_t", watermark)
            .groupBy(F.window("_t", "1 day"))
            .agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("rows"))
            .select(F.to_date(F.col("window.start")).alias("day"), "mean", "rows"))


def start_daily_means(stream: DataFrame, time_col: str, value_col: str, sink: str,
                      checkpoint: str, fmt: str = "parquet", mode: str = "append",
                      watermark: str = "2 days") -> StreamingQuery:
    """Start the query writing finished days to ``sink`` (a fault-tolerant file sink
    with its checkpoint in the shared folder)."""
    return (daily_means_stream(stream, time_col, value_col, watermark).writeStream
            .format(fmt).outputMode(mode).option("path", sink)
            .option("checkpointLocation", checkpoint).start())
