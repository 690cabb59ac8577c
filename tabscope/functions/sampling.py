"""Uniform samples of rows that cost one scan and move little more than the sample.

Every row draws a 64-bit number by a seeded hash of its place (partition and
position in it, ``monotonically_increasing_id``), so equal rows draw on their own
and come as often as they occur. The sample is the ``k`` rows with the smallest
numbers. With the number of rows known, a draw above (k + 8 sqrt(k) + 64) / n of
the range can be among the k smallest with a chance below 1e-13 only, so tasks
drop those at once: about ``k`` rows reach the final top-k whatever the number of
tasks, and nothing is grouped, sorted or re-expanded before.

A sample is the same for a seed and a layout of the input's partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .missing import quote

#: Categories (the most frequent ones) whose bounds are broadcast; the others have few rows.
HOT_GROUPS = 10_000


def _reach(k: int) -> float:
    """Draws that are kept in the mean so that at least ``k`` of them are."""
    return k + 8 * math.sqrt(k) + 64


def _drawn(df: DataFrame, seed: int) -> DataFrame:
    """``row`` (all columns) and ``h``, the row's draw."""
    return df.select(F.struct(*[F.col(quote(c)) for c in df.columns]).alias("row"),
                     F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("h"))


def _under(h: Column, share: Column) -> Column:
    return h.cast("double") < (share - 0.5) * 2.0 ** 64


def bottom_k(df: DataFrame, k: int, seed: int = 42, n: int | None = None, draw: str | None = None) -> DataFrame:
    """``k`` rows of ``df`` drawn uniformly, all of them if it has fewer, by ascending draw.

    ``n`` is its number of rows (counted if not given); ``draw`` names a column to return the draws in.
    """
    n = df.count() if n is None else n
    rows = _drawn(df, seed)
    if _reach(k) < n:
        rows = rows.filter(_under(F.col("h"), F.lit(_reach(k) / n)))
    top = rows.orderBy("h").limit(k)
    return top.select("row.*", *([F.col("h").alias(draw)] if draw else []))


def bottom_k_by(df: DataFrame, by: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows of each value of ``by`` (missing values are one group) drawn uniformly.

    The most frequent values' draws are cut before the shuffle, so a value that holds a third of all rows sends
    about ``k`` of them to its task.
    """
    rows = _drawn(df, seed).withColumn("g", F.col("row").getField(by))
    hot = (rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * _reach(k))
           .orderBy(F.col("n").desc(), "g").limit(HOT_GROUPS).withColumnRenamed("g", "hot"))
    rows = rows.join(F.broadcast(hot), F.col("g").eqNullSafe(F.col("hot")), "left").filter(
        F.col("n").isNull() | _under(F.col("h"), F.lit(_reach(k)) / F.col("n")))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("row.*")
