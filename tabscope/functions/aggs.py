"""Wide one-row aggregations that stay inside whole-stage codegen.

Spark generates code for a hash aggregate only while its buffer has at most
``spark.sql.codegen.maxFields`` (100) fields; one more and the whole aggregate
runs interpreted, several times slower per row. ``agg_row`` splits a long list
of aggregate expressions into chunks below that width (each chunk scans only its
own columns, which Parquet column pruning makes cheap) and returns one merged
dict of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

MAX_FIELDS = 90


def agg_row(df: DataFrame, named: list[tuple[str, Column, int]], max_fields: int = MAX_FIELDS) -> dict:
    """``named`` = ``[(alias, aggregate_expr, buffer_width), ...]`` → ``{alias: value}``.

    Buffer widths: count/sum/min/max/count_if/bool_and 1, avg 2, stddev/variance 3,
    covariance 4, skewness 4, kurtosis 5, corr 6."""
    out: dict = {}
    chunk: list[Column] = []
    width = 0
    for alias, expr, w in named:
        if chunk and width + w > max_fields:
            out.update(df.agg(*chunk).first().asDict())
            chunk, width = [], 0
        chunk.append(expr.alias(alias))
        width += w
    if chunk:
        out.update(df.agg(*chunk).first().asDict())
    return out
