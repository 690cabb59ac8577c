"""The findings table that replaces the reference's UI messages (section, column,
check, severity, metric, detail). Findings are summaries — at most a few rows
per column — assembled from small aggregate results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDINGS_DDL = ("section string, column_name string, check string, severity string, "
                "metric double, detail string")


def finding(section: str, column: str | None, check: str, severity: str,
            metric: float | None = None, detail: str | None = None) -> tuple:
    return (section, column, check, severity, None if metric is None else float(metric), detail)


def findings_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDINGS_DDL)
