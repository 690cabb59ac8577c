"""Table readers (S1–S7) and shape/schema/preview.

Everything is read by Spark's distributed file sources. CSV typing is done
here instead of Spark's ``inferSchema`` because pandas recognises a whole list
of missing-value tokens: the file is read as text, the tokens become NULL, and
one aggregation over all columns decides which columns are integral, floating
or boolean; a single projection then applies the types.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import agg_row
from ..functions.missing import normalize_missing, quote
from ..functions.numbers import numeric_text

# pandas' default missing-value tokens for read_csv.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# Texts pandas reads as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

SUPPORTED = {"csv": "csv", "txt": "csv", "json": "json", "parquet": "parquet"}


def _typed_from_text(df: DataFrame, na_tokens: list[str]) -> DataFrame:
    cols = df.columns
    cleaned = df.select(*[F.when(F.col(quote(c)).isin(na_tokens), F.lit(None))
                          .otherwise(F.col(quote(c))).alias(c) for c in cols])
    checks = []
    for i, c in enumerate(cols):
        v = F.col(quote(c))
        t = F.trim(v)
        checks += [
            (f"i{i}", F.count_if(v.isNotNull() & numeric_text(t, "bigint").isNull()), 1),
            (f"d{i}", F.count_if(v.isNotNull() & numeric_text(t).isNull()), 1),
            (f"b{i}", F.count_if(v.isNotNull() & ~v.isin(TRUE_TOKENS + FALSE_TOKENS)), 1),
            (f"n{i}", F.count(v), 1),
        ]
    if not cols:
        return cleaned
    r = agg_row(cleaned, checks)
    out = []
    for i, c in enumerate(cols):
        v = F.col(quote(c))
        if r[f"n{i}"] == 0:
            out.append(v.cast("double").alias(c))          # all missing → float NaN column
        elif r[f"b{i}"] == 0:
            out.append(F.when(v.isin(TRUE_TOKENS), F.lit(True))
                       .when(v.isin(FALSE_TOKENS), F.lit(False)).alias(c))
        elif r[f"i{i}"] == 0:
            out.append(F.trim(v).cast("bigint").alias(c))
        elif r[f"d{i}"] == 0:
            out.append(F.trim(v).cast("double").alias(c))
        else:
            out.append(v.alias(c))
    return normalize_missing(cleaned.select(*out))


_BAD_RECORD = "_tabscope_bad_record"


def scan_csv(spark: SparkSession, path: str, na_tokens: list[str] | None = None,
             sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """CSV (or comma-separated .txt) with a header row; types inferred pandas-style.

    Quotes inside quoted fields are doubled. A quoted field may hold line ends;
    files that have such fields cannot be split among tasks, so unless
    ``multiline`` says so, one pass over the lines looks for an odd number of
    quotes first. A line with more fields than the header raises ``ValueError``;
    missing trailing fields are NULL."""
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multiline,
               "inferSchema": False, "emptyValue": "", "mode": "PERMISSIVE", "columnPruning": False,
               "columnNameOfCorruptRecord": _BAD_RECORD}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        return spark.read.options(**options).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _BAD_RECORD]])
    raw = spark.read.schema(schema).options(**options).csv(path)
    bare = F.regexp_replace(F.col(_BAD_RECORD), '"([^"]|"")*"', "")
    extra = F.col(_BAD_RECORD).isNotNull() & (
        F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= len(names) * len(sep))
    if raw.agg(F.count_if(extra), F.count(quote(names[0]))).first()[0]:
        raise ValueError(f"{path}: a line has more than {len(names)} fields")
    return _typed_from_text(raw.drop(_BAD_RECORD), NA_TOKENS if na_tokens is None else na_tokens)


def _first_line(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    return rows[0][0] if rows else None


def scan_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON array of records (multi-line) or JSON lines; column order of the first record."""
    first = _first_line(spark, path)
    if multiline is None:
        multiline = bool(first) and first.lstrip().startswith("[")
    df = spark.read.option("multiLine", multiline).json(path)
    order: list[str] = []
    if first and not multiline:
        try:
            order = list(json.loads(first).keys())
        except ValueError:
            order = []
    if order and set(order) <= set(df.columns):
        df = df.select(*[quote(c) for c in order + [c for c in df.columns if c not in order]])
    return normalize_missing(df)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Dispatch on the extension after the last dot; unknown formats raise (S3)."""
    base = os.path.basename(path.rstrip("/"))
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    kind = SUPPORTED.get(ext)
    if kind is None:
        raise ValueError(f"unsupported file format {ext!r}; expected one of {sorted(SUPPORTED)}")
    if kind == "csv":
        return scan_csv(spark, path, **options)
    if kind == "json":
        return scan_json(spark, path, **options)
    return normalize_missing(spark.read.parquet(path))


def table_shape(df: DataFrame) -> DataFrame:
    """rows × columns (S4) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint"))


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column → data type report (S5); metadata only, no data read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([T.StructField("position", T.IntegerType()),
                           T.StructField("column_name", T.StringType()),
                           T.StructField("data_type", T.StringType())])
    return spark.createDataFrame(rows, schema)


def preview_head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (S6). Spark has no file order, so an explicit order is used
    (the given columns, else all columns); Spark plans it as a top-k, not a sort."""
    keys = order_by or df.columns
    return df.orderBy(*[F.col(quote(c)).asc_nulls_last() for c in keys]).limit(n)
